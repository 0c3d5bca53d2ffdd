"""Settings kept as tags in the store itself: visibility, arity, value types.

All three are read from three reserved namespaces below one root, whose name is the store's
choice; a setting's target stands in the key of its tag, as ``ns:key`` split at the first
colon, or ``key`` alone for the null namespace.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

from tagloom.model import Atom, Tag, Wild

#: Root of the reserved namespaces, unless a store names another.
ROOT_NS = "settings"


def hide_ns(root: str = ROOT_NS) -> str:
    return f"{root}.hide"


def arity_ns(root: str = ROOT_NS) -> str:
    return f"{root}.arity"


def type_ns(root: str = ROOT_NS) -> str:
    return f"{root}.type"


Target = tuple[str | None, str]


def split_target(text: str) -> Target:
    """``a:b:c`` is ``(a, b:c)``; without a colon the namespace is null."""
    head, colon, tail = text.partition(":")
    return (head, tail) if colon else (None, head)


def under(ns: str, root: str) -> bool:
    """Whether ns is root or lies below it in the dotted hierarchy."""
    return ns == root or ns.startswith(root + ".")


@dataclass(frozen=True, slots=True)
class HidePattern:
    """ns: None is the null namespace, Wild.ANY any, else a dotted subtree."""

    ns: str | Wild | None
    key: str | Wild

    @classmethod
    def of(cls, target: str) -> HidePattern:
        ns, key = split_target(target)
        return cls(Wild.ANY if ns == "*" else ns, Wild.ANY if key == "*" else key)

    def covers(self, ns: str | None, key: str) -> bool:
        if self.key is not Wild.ANY and self.key != key:
            return False
        if self.ns is Wild.ANY:
            return True
        return ns is None if self.ns is None else ns is not None and under(ns, self.ns)

    def revealed_by(self, reference: Target | tuple[str | None, Wild]) -> bool:
        """A reference must be at least as specific in both positions."""
        ns, key = reference
        if self.key is not Wild.ANY and key is not Wild.ANY and key != self.key:
            return False
        if self.ns is Wild.ANY:
            return True
        return ns is None if self.ns is None else ns is not None and under(ns, self.ns)


def reference_of(atom: Atom) -> tuple[str | None, str | Wild] | None:
    """What an atom names; a quantified namespace names nothing."""
    if isinstance(atom.ns, Wild):
        return None
    return atom.ns, Wild.ANY if isinstance(atom.key, Wild) else atom.key


@dataclass(frozen=True)
class HideConfig:
    """The hide patterns in force."""

    patterns: tuple[HidePattern, ...]

    @classmethod
    def default(cls, root: str = ROOT_NS) -> HideConfig:
        return cls.from_tags((), root)

    @classmethod
    def from_patterns(cls, patterns: Iterable[str | HidePattern]) -> HideConfig:
        """Exactly these patterns, without the default."""
        made = (p if isinstance(p, HidePattern) else HidePattern.of(p) for p in patterns)
        return cls(tuple(dict.fromkeys(made)))

    @classmethod
    def from_tags(cls, tags: Iterable[Tag], root: str = ROOT_NS) -> HideConfig:
        """Per target ``true`` beats ``false``; other values configure nothing. The root
        itself is hidden unless a setting says ``false`` for it."""
        says: dict[str, set[str]] = defaultdict(set)
        for t in tags:
            if t.ns == hide_ns(root) and t.value in ("true", "false"):
                says[t.key].add(t.value)
        on = [k for k, v in says.items() if "true" in v]
        if f"{root}:*" not in says:
            on.append(f"{root}:*")
        return cls.from_patterns(sorted(on))

    def tag_hidden(self, tag: Tag) -> bool:
        """Display rule: no query, nothing revealed."""
        return any(p.covers(tag.ns, tag.key) for p in self.patterns)

    def unrevealed(self, references: Iterable) -> tuple[HidePattern, ...]:
        refs = [r for r in references if r is not None]
        return tuple(p for p in self.patterns if not any(p.revealed_by(r) for r in refs))


@dataclass(frozen=True)
class StoreConfig:
    """Everything a query needs to know from the settings."""

    hide: HideConfig = field(default_factory=HideConfig.default)
    types: dict[Target, str] = field(default_factory=dict)

    @classmethod
    def from_tags(cls, tags: Iterable[Tag], root: str = ROOT_NS) -> StoreConfig:
        """A target with two different type names has none."""
        tags = list(tags)
        names: dict[Target, set[str]] = defaultdict(set)
        for t in tags:
            if t.ns == type_ns(root) and t.value is not None:
                names[split_target(t.key)].add(t.value)
        return cls(HideConfig.from_tags(tags, root), {k: next(iter(v)) for k, v in names.items() if len(v) == 1})
