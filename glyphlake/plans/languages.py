"""Which of a set of supported language tags serves a tag, decided when the plan is made."""

from __future__ import annotations

from ..functions.tables import ALIASES


class MissingLanguageError(ValueError):
    """No language was given."""


class UnsupportedLanguageError(ValueError):
    """No supported tag is near enough."""


def match_lang(target: str | None, supported: list[str]) -> str:
    """The supported tag for a target: equal ones first, then those with the same language and the most subtags in common.

    Three-letter codes stand for their two-letter ones.  Another script than the supported tag's is no match; other regions are.
    """
    if not target or target.lower() == "und":
        raise MissingLanguageError("a language is needed")

    def parts(tag: str) -> list[str]:
        head, *rest = tag.replace("_", "-").lower().split("-")
        return [ALIASES.get(head, head), *rest]

    want = parts(target)
    script = lambda p: next((x for x in p[1:] if len(x) == 4 and x.isalpha()), None)
    near = [s for s in supported if parts(s)[0] == want[0] and (script(want) is None or script(parts(s)) in (None, script(want)))]
    if not near:
        raise UnsupportedLanguageError(f"{target!r} is not supported; {', '.join(supported)} are")
    return max(near, key=lambda s: (parts(s) == want, len(set(parts(s)) & set(want)), -len(parts(s)), -supported.index(s)))


def differs_from(a: dict, b: dict) -> list[str]:
    """Names of the fields in which two identities (of backend, version, language, table revision) differ."""
    return sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k))
