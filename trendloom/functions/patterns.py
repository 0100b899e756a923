"""Regular expressions built from word lists."""

from __future__ import annotations

from collections.abc import Iterable

WORD_CHAR = r"[\p{L}\p{N}_]"
CASHTAG = rf"\$([A-Za-z]{{1,5}})(?!{WORD_CHAR})"

GROUP = 5
_META = set(r"\^$.|?*+()[]{}&-")


def literal(ch: str) -> str:
    return "\\" + ch if ch in _META else ch


def any_of(terms: Iterable[str], whole_word: bool = False) -> str:
    """A pattern that finds any of the literal terms.

    The JVM tries alternatives one by one at every position, so a flat list of a hundred words
    costs a hundred attempts per character. Terms are therefore merged on common prefixes, and
    many branches are guarded in groups by the characters they start with.
    """
    root: dict = {}
    for term in terms:
        node = root
        for ch in term:
            node = node.setdefault(ch, {})
        node[""] = {}

    def render(node: dict) -> str:
        ends = "" in node
        if ends and not whole_word:
            return ""
        branches = [(ch, literal(ch) + render(child)) for ch, child in sorted(node.items()) if ch]
        if not branches:
            return ""
        if len(branches) == 1 and not ends:
            return branches[0][1]
        return "(?:" + "|".join(grouped(branches)) + ")" + ("?" if ends else "")

    def grouped(branches: list[tuple[str, str]]) -> list[str]:
        if len(branches) <= GROUP:
            return [body for _, body in branches]
        groups = [branches[i : i + GROUP] for i in range(0, len(branches), GROUP)]
        return [
            "(?=[" + "".join(literal(ch) for ch, _ in g) + "])(?:" + "|".join(b for _, b in g) + ")"
            for g in groups
        ]

    pattern = render(root)
    if whole_word:
        return rf"(?<!{WORD_CHAR})(?:{pattern})(?!{WORD_CHAR})"
    return pattern
