"""Whether a text is English, by its script and by function words, whatever else is known."""

from __future__ import annotations

import re

#: Words that every text of a language has. Those that are common in several of these
#: languages are left out, so each tells its language.
ENGLISH = frozenset(
    """the of to and is are it that by with from for this which we you your he she they them
    their his her its our my be been being were had has have having does did doing not
    can could will would shall should may might must at into onto out when where what
    who whom whose why how if then than there these those because but or every each any
    some somebody someone something nobody nothing everybody everyone everything anybody
    anything always never often sometimes another other others many much more most only
    very too after before about over under between through during while until since both
    either neither such first next now here up down off again once one two
    said wherein whereby thereof therein himself herself itself themselves""".split()
)
OTHERS = tuple(
    frozenset(words.split())
    for words in (
        # German
        """der das und ist nicht ein eine einer einem einen eines dem den des mit von vom zu zum zur auf
        aus bei beim für gegen nach über unter wird werden wurde sind sich dass daß dadurch durch als
        auch oder aber wenn wie ich er sie es wir ihr noch nur sehr kann können hier im am viel mehr bisher""",
        # French
        """le la les un une du des et est sont dans sur par pour avec que qui ce cette ces ne pas plus
        au aux en il elle ils nous vous leur mais ou où comme dont sans selon être peut même dès ainsi""",
        # Spanish
        """el la los las un una del de y es son en con por para que se al lo su sus no más pero como
        cuando si sin sobre este esta muy según porque hacia puede qué menos tiene""",
        # Portuguese
        """o os um uma uns umas do da dos das e é são em no na nos nas com por para que se ao não mais mas como
        quando sem sobre este esta muito segundo pode seu sua pelo pela""",
        # Italian
        """il lo la gli le un una uno di del della dei delle e è sono in con per che si al alla non più ma
        come quando se senza su questo questa molto secondo può suo sua dal dalla nel nella""",
        # Dutch
        """de het een van en is niet met voor op aan bij door uit naar over onder wordt worden zijn zich dat
        die als ook of maar hoe ik hij zij wij nog zeer kan hier veel meer""",
    )
)
#: Words that are English too tell nothing against English.
OTHERS = tuple(o - ENGLISH - {"in", "is", "no", "on", "an", "as", "a", "o", "e", "y", "of", "die", "over", "do"} for o in OTHERS)
_FOREIGN = frozenset().union(*OTHERS)
#: Letters of scripts with about a word in every two signs, and of all other scripts but Latin.
_DENSE = re.compile("[々-ヿ㐀-鿿가-힣豈-﫿\U00020000-\U0003ffff]")
_FAR = re.compile("[Ͱ-᷿]")
#: A dense sign stands for as much text as this many letters.
_WEIGHT = 3
#: One word in so many has to tell its language.
_LEAST = 30


def is_english(text: str, found: list[str]) -> bool | None:
    """None if nothing tells. found: the text's words in lower case. A text of two languages
    is of the one with more of its function words."""
    if not found:
        return None
    if not text.isascii():
        dense, far = len(_DENSE.findall(text)), len(_FAR.findall(text))
        if _WEIGHT * dense + far > sum(map(len, found)) - dense - far:
            return False
    english = sum(map(ENGLISH.__contains__, found))
    foreign = [w for w in found if w in _FOREIGN]
    other = max(sum(map(o.__contains__, foreign)) for o in OTHERS) if len(foreign) >= english else len(foreign)
    if max(english, other) * _LEAST < len(found) or english == other:
        return None
    return english > other
