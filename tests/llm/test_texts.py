import base64
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.llm import encode, english, leaks, levels, terms
from tagloom.llm.words import words
from tagloom.model import WRITES

# 6: frequencies


def brute_counts(rows):
    once = {}
    for k, (seq, pos, i, ns, key, value) in enumerate(rows):
        if key is not None:
            once[(k,) if seq is None or pos is None else (seq, pos, i, ns, key, value)] = (i, ns, key, value)
    tags, parts = defaultdict(list), defaultdict(list)
    for i, ns, key, value in once.values():
        tags[ns, key, value].append(i)
        for grain, term in (("ns", ns), ("key", key), ("value", value)):
            if term is not None:
                parts[grain, term].append(i)
    count = lambda d: {(*k, len(v), len(set(v) - {None})) for k, v in d.items()}
    return count(tags), count(parts)


def writes(seed=1):
    rng = random.Random(seed)
    rows = [
        (k // 3 if rng.random() < 0.97 else None, k % 3, rng.choice([None, "", *[f"i{n}" for n in range(30)]]), rng.choice([None, "n", ""]), rng.choice(["hot"] * 8 + ["a", None]), rng.choice([None, "", "v", f"u{k}"]))
        for k in range(700)
    ]
    rows += rng.sample(rows, 90)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts,hold", [(1, 500_000), (7, 100), (30, 500_000)])
def test_counts(spark, monkeypatch, parts, hold):
    """However the line is cut."""
    rows = writes(parts)
    monkeypatch.setattr(terms, "HOLD", hold)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, WRITES).repartition(4)
        tags, of_parts = brute_counts(rows)
        counted = terms.tag_counts(df)
        assert {tuple(r) for r in counted.collect()} == tags
        assert {tuple(r) for r in terms.part_counts(df, counted).collect()} == of_parts
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_task_meets_a_hot_term_or_record_whole(spark):
    """A third of the rows are of one tag, a third of one record, and a third can't be told apart."""
    rows = [(k, 0, f"i{k}", None, "hot", "v") for k in range(3_000)] + [(k, 1, "big", None, f"k{k % 40}", str(k)) for k in range(3_000)] + [(None, 0, "same", None, "j", "w")] * 3_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        df = spark.createDataFrame(rows, WRITES).repartition(5)
        seen = [r["count"] for r in terms.lined_up(df, terms.TAG).groupBy(F.spark_partition_id()).count().collect()]
        assert len(seen) >= 11 and max(seen) < 2 * len(rows) / 12
        got = {(r.key, r.value): (r.occurrences, r.records) for r in terms.tag_counts(df).collect()}
        assert got["hot", "v"] == (3_000, 3_000) and got["j", "w"] == (3_000, 1) and len(got) == 3_002
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_marks(spark):
    rows = [(k, 0, f"i{k % 100}", "n", "k", None) for k in range(200)] + [(k, 1, "i1", None, "r", "x" * 50_000) for k in range(2)] + [(k, 2, f"i{k}", None, "c", "") for k in range(8)] + [(0, 1, "i1", None, "r", "x" * 50_000)]
    df = spark.createDataFrame(rows, WRITES)
    assert {tuple(r) for r in terms.marked_tags(df).collect()} == {("n:k", "common"), ("r=" + "x" * 50_000, "rare")}
    assert terms.marked_tags(df.limit(0)).collect() == [] and terms.all_terms(df.limit(0)).collect() == []
    wide = df.selectExpr("*", "1 AS n", "'x' AS salt", "2 AS occurrences")
    assert terms.all_terms(wide).count() == 3 + 1 + 3 + 2


# 7: encoding


@pytest.fixture(scope="module")
def path():
    pytest.importorskip("public_tokenizers")
    return encode.vocabulary_path()


@pytest.fixture(scope="module")
def reference(path):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encode.load_ranks(path), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
@example(text="<|endoftext|> it's  we'll\x1c\x85 ½ ²Ⅷ १ é é ​   \n\n x")
@example(text=" 'S 's _a__b 1_2 �\U0001f600")
def test_ids_are_the_library_s(text, path, reference):
    assert list(encode.encode(text, path)) == reference.encode_ordinary(text)


def test_long_pieces(path, reference):
    rng = random.Random(3)
    for text in ("ab" * 30_000, "a" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "é漢" * 5_000, " " * 9_999):
        assert list(encode.encode(text, path)) == reference.encode_ordinary(text)


def test_merge_takes_the_leftmost_of_equal_ranks():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"aaa": 3}
    assert encode.merge(b"aaab", ranks) == [3, 1] and encode.merge(b"aaaa", ranks) == [2, 2] and encode.merge(b"b", ranks) == [1]


def test_memory_is_emptied(path, reference, monkeypatch):
    monkeypatch.setattr(encode, "MEMORY", 3)
    encode._pieces(path).clear()
    text = "many different words that do not fit at once"
    assert list(encode.encode(text, path)) == reference.encode_ordinary(text) and len(encode._pieces(path)) <= 3


def test_encode_column(spark, path, reference):
    rows = [(1, "Hello world", "x"), (2, "", "y"), (3, None, "z"), (3, None, "z"), (4, "é" * 100_000, "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = encode.encode_column(df)
    assert got.columns == ["doc_id", "ids"] and got.schema["ids"].dataType.simpleString() == "array<int>"
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == [(i, reference.encode_ordinary(t or "")) for i, t, _ in rows]
    assert encode.encode_column(df.limit(0)).collect() == []
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    back = {v: k for k, v in ranks.items()}
    assert b"".join(back[i] for i in encode.encode(rows[4][1], path)).decode() == rows[4][1]


# 8: leaks


def test_plain_words():
    assert words("The Fire-\nDrill [0012] (7) cost 5 ﬁne ＣＯＩＮＳ­!") == words("the firedrill cost 5 fine coins")
    assert words(None) == [] and words("Café") == words("café") == ["cafe"]


def items(seed=2, n=30):
    rng = random.Random(seed)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(500)]
    return [(i, " ".join(rng.choices(vocabulary, k=rng.randint(40, 90)))) for i in range(n)], [f"x{k}" for k in range(3000)], rng


def test_suffix_array_order():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 400)
    text[-1] = 0
    end = lambda p: next(k for k in range(p, len(text)) if text[k] == 0)
    got = leaks.suffix_array(text, 3, 400)
    want = sorted((p for p in range(len(text)) if end(p) - p >= 3), key=lambda p: (text[p : end(p)].tolist()))
    assert [text[p : end(p)].tolist() for p in got] == [text[p : end(p)].tolist() for p in want]


def test_planted_leaks(spark):
    tests, other, rng = items()
    docs, true = [], set()
    for d in range(160):
        body = rng.choices(other, k=150) + rng.sample(tests[rng.randrange(len(tests))][1].split(), 20)
        item, text = tests[rng.randrange(len(tests))]
        ws = text.split()
        kind = d % 5
        share = (1, 0.65, 0.4, 1, 0.8)[kind]
        start = rng.randint(0, int(len(ws) * (1 - share)))
        piece = ws[start : start + round(len(ws) * share)]
        if kind == 3:
            rng.shuffle(piece)
        if kind in (1, 4):  # about one word in ten changed, added or left out
            for _ in range(len(piece) // 11):
                k = rng.randrange(1, len(piece) - 1)
                piece[k : k + 1] = rng.choice([[], [rng.choice(other)], [piece[k], rng.choice(other)]])
        if kind in (0, 1, 4):
            true.add((d, item))
        at = rng.randint(0, 150)
        glue = rng.choice([" ", ", ", "\n", " - ", "  "])
        docs.append((d, glue.join([*body[:at], *(w.upper() if d % 2 else w for w in piece), *body[at:]]), "extra"))
    docs += [(900, None, ""), (901, "", ""), (902, tests[0][1], ""), (902, tests[0][1], "")]
    true.add((902, 0))
    bench = spark.createDataFrame([*tests, (77, None), (78, "too short"), (79, "")], "item_id bigint, text string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string").repartition(3)
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(df, bench).collect()}
    assert got == true
    clean = {r.doc_id for r in leaks.without_leaks(df, bench).collect()}
    assert clean == {d[0] for d in docs} - {d for d, _ in true}
    assert leaks.leaks(df.limit(0), bench).collect() == [] and leaks.leaks(df, bench.limit(0)).collect() == []
    # Items in several groups leak the same.
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(df, bench, leaks.Params(max_chars=2_000)).collect()} == true


def test_matches_are_all_the_maximal_ones():
    tests, other, rng = items(4, 8)
    params = leaks.Params(block=500)
    its = leaks.Items(tests, params)
    (kind,) = its.kinds
    kind.need[:] = 1
    pool: list[str] = []
    for _ in range(150):
        ws = rng.choice(tests)[1].split()
        start = rng.randrange(len(ws))
        pool += ws[start : start + rng.randint(2, 9)] + rng.choices(other, k=rng.randint(0, 1))
    text = np.array([its.vocabulary.get(w, 0) for w in pool + tests[2][1].split()] + [0])
    n = len(tests)
    got = set()
    for pair, p, q, size in leaks._matches(leaks.Found(text, kind, 100), kind, np.zeros(n, int), np.arange(n), np.zeros(1, int), params):
        got |= {(a, pair, b, c) for a, b, c in zip(p.tolist(), q.tolist(), size.tolist(), strict=True)}
    want = set()
    for i in range(len(tests)):
        item = its.wording(i)
        for p in range(len(text)):
            for q in range(len(item)):
                if p and q and text[p - 1] == item[q - 1]:
                    continue
                n = 0
                while p + n < len(text) and q + n < len(item) and text[p + n] == item[q + n]:
                    n += 1
                if n >= 4:
                    want.add((p, i, q, n))
    # A match that a window's border cuts is whole in another window.
    assert want <= got and len(want) > 50
    assert all(any(i == j and p - q == a - b and a <= p and p + n <= a + m for a, j, b, m in want) for p, i, q, n in got)


def counts_by_brute_force(text, item, params):
    """Whether a stretch of the text repeats enough of the item: for every first word of the
    item the best alignment that begins anywhere in the text."""
    good, bad = params.slack(1, 0), params.slack(0, 1)
    for a in range(len(item)):
        row = [0.0] * (len(text) + 1)
        for b in range(a, len(item)):
            new = [row[0] + bad]
            for j, w in enumerate(text, 1):
                new.append(max(row[j - 1] + (good if w == item[b] else bad), row[j] + bad, new[-1] + bad))
            row = new
            if b - a + 1 >= params.least_span(len(item)) and max(row) >= -1e-9:
                return True
    return False


def spoiled(piece, n, rng, other):
    piece = list(piece)
    for k in rng.sample(range(1, len(piece) - 1), n):
        piece[k] = rng.choice([[], [rng.choice(other)], [piece[k], rng.choice(other)]])
    return [x for w in piece for x in (w if isinstance(w, list) else [w])]


def test_stretches_against_brute_force():
    """Random errors up to and beyond the limit, at and about the least span."""
    tests, other, rng = items(6, 12)
    tests = [(i, " ".join(t.split()[: rng.choice([3, 6, 10, 14, 24, 45])])) for i, t in tests]
    params = leaks.Params()
    its = leaks.Items(tests, params)
    docs = []
    for d in range(300):
        item = tests[d % len(tests)][1].split()
        least = params.least_span(len(item))
        span = min(len(item), least + rng.randint(-1, 5))
        start = rng.randint(0, len(item) - span)
        piece = item[start : start + span]
        piece = spoiled(piece, min(rng.randint(0, int(0.2 * span) + 1), max(span - 2, 0)), rng, other) if span > 2 else piece
        docs.append([*rng.choices(other, k=rng.randint(0, 9)), *piece, *rng.choices(other, k=4)])
    got = {(f[0], f[1]) for f in leaks.scan([" ".join(d) for d in docs], its, params)}
    want = {(d, i) for d, doc in enumerate(docs) for i in range(len(tests)) if counts_by_brute_force(doc, tests[i][1].split(), params)}
    assert 100 < len(want) < 290 and got == want


def test_errors_near_the_ends():
    """The first 23 of 45 words, of which the 4th, 8th and 12th are changed."""
    item = [f"w{k}x" for k in range(45)]
    doc = item[:23]
    doc[3], doc[7], doc[11] = "other", "words", "here"
    its = leaks.Items([(5, " ".join(item))], leaks.Params())
    (found,) = leaks.scan([" ".join(doc)], its, leaks.Params())
    assert found[2:4] == (20, 23) and found[6] == 11


def test_shared_wording_brings_nothing_together():
    """Every document and every item hold one phrase, over and over: neither every pair is
    looked at nor does repetition add up to a case."""
    import time

    rng = random.Random(8)
    phrase = "as set out in any of the claims".split()
    own = lambda tag, n: [f"{tag}{rng.randrange(10**6)}z" for _ in range(n)]
    tests = [(i, " ".join([*own("a", 20), *phrase, *own("b", 20), *phrase, *own("c", 8)])) for i in range(500)]
    docs = [" ".join([*own("d", 40), *phrase] * 6) for _ in range(500)] + [" ".join(["none", *tests[7][1].split()[:40]]), " ".join(phrase * 3_000)]
    params = leaks.Params()
    its = leaks.Items(tests, params)
    began = time.time()
    assert {(f[0], f[1]) for f in leaks.scan(docs, its, params)} == {(500, 7)}
    assert time.time() - began < 20
    (kind,) = its.kinds
    assert kind.n_picked.max() < 500  # the phrase picks no document


def test_a_word_repeated_without_end():
    its = leaks.Items([(1, "so " * 60), (2, "one two three four so so so so so five six seven")], leaks.Params())
    assert {f[1] for f in leaks.scan(["so " * 50_000], its, leaks.Params(block=10_000))} == {0}


# 9: reading levels


def graded(seed=1, n=400):
    rng = random.Random(seed)
    by_level = {lv: [f"{'abcd'[lv - 1]}word{'qwertyuiop'[k % 10]}{chr(97 + k // 10)}" for k in range(60)] for lv in levels.LEVELS}
    glue = [f"glue{chr(97 + k)}" for k in range(20)]
    out = []
    for d in range(n):
        lv = rng.choice([1, 2, 3, 3, 4])
        near = [x for x in (lv - 1, lv + 1) if x in by_level]
        text = []
        for _ in range(rng.randint(15, 60)):
            text.append(rng.choice(glue) if rng.random() < 0.3 else rng.choice(by_level[lv if rng.random() < 0.75 else rng.choice(near)]))
        out.append((d, " ".join(text).capitalize() + ".", lv))
    return out


def test_levels_of_held_out_documents(spark):
    docs = graded()
    rows = [(d, t, "en") for d, t, _ in docs] + [(1000, None, None), (1001, "", "en"), (1002, "short", "en"), (1003, "fremde worte und noch viel mehr fremde worte hier im text", "en"), (1004, "漢字" * 40, "en"), (1005, docs[0][1] * 3000, "de")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, level string").repartition(3)
    marks = spark.createDataFrame([(d, lv) for d, _, lv in docs if d % 2] + [(1, 9), (5555, 1), (1003, None)], "doc_id bigint, level bigint")
    got = {r.doc_id: r.level for r in levels.reading_levels(df, marks).collect()}
    held = [(got[d], lv) for d, _, lv in docs if d % 2 == 0]
    assert sum(a == b for a, b in held) >= 0.93 * len(held)
    assert all(got[k] is None for k in (1000, 1001, 1002, 1003, 1004)) and got[1005] == docs[0][2]


def test_levels_without_labels(spark):
    df = spark.createDataFrame([(1, "some words that are long enough to be graded at all")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, level bigint")
    assert [r.level for r in levels.reading_levels(df, none).collect()] == [None]
    assert levels.reading_levels(df.limit(0), none).collect() == []
    one = spark.createDataFrame([(1, 4)], "doc_id bigint, level bigint")
    assert levels.reading_levels(df, one, levels.Params(least_docs=1)).collect()[0].level == 4


def test_the_sample_is_bounded(spark, sf):
    documents, marks = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "doc_levels"))
    model = levels.fit(documents, marks, levels.Params(max_labels=5))
    assert len(model.grades.words) < 2_000


def test_grades_rise_with_level():
    documents = np.array([10.0, 10, 10, 10])
    g = levels.grade(np.array([[9, 1, 0, 0], [0, 0, 1, 9], [5, 5, 5, 5]]), documents)
    assert g[0] < 1.4 and g[1] > 3.6 and g[2] == pytest.approx(2.5)
    assert Counter(levels.tokens("A b1 c_d é!")) == Counter("a b c d é".split())


def test_a_small_sample_drops_no_english_text(spark):
    easy = "Grandmother always finishes the strawberry pudding before dinnertime, and then we all wash the dishes with her."
    hard = "The method according to claim one is characterised in that the polymer comprises a crosslinked copolymer of high modulus."
    french = "Le procédé selon la revendication est caractérisé en ce que le polymère est un copolymère, ainsi il se détache sans outil."
    mixed = "所述转轴可由金属制成，皮带由塑料制成。所述壳体通过转轴与容器相连。当支架停止时，转轴控制容器关闭。" * 2 + hard
    rows = [(1, hard), (2, hard + " It is so."), (3, easy), (4, french), (5, mixed), (6, "Umbrella toothbrush wheelbarrow sandwich bathtub butterfly"), (7, french + " Graded.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(1, 4), (2, 4), (7, 3)], "doc_id bigint, level bigint")
    got = {r.doc_id: r.level for r in levels.reading_levels(df, marks, levels.Params(least_docs=2)).collect()}
    assert all(got[k] is not None for k in (1, 2, 3, 7)) and all(got[k] is None for k in (4, 5, 6))
    # A text none of whose words is known has a level too.
    none = levels.Model(levels.Grades({}), levels.calibrate(np.eye(20), np.array([1, 2] * 10), 1e-3), levels.Params())
    assert none.predict([easy])[0][0] is not None


def test_english_by_function_words():
    tell = lambda t: english.is_english(t, levels.tokens(t))
    assert tell("We made the soup and nobody noticed it, because they were all outside.")
    for other in ("Das Gehäuse ist mit einem Deckel verbunden, der sich öffnet.", "El sensor se mueve hacia la válvula según la señal.", "O motor do carro não está na garagem.", "Клапан соединен с корпусом"):
        assert tell(other) is False
    assert tell("glueb aworda awordb gluec") is None and tell("") is None
