"""Case rules for names on the wire."""

from __future__ import annotations

# The rules.
RULES = ("lowercase", "UPPERCASE", "PascalCase", "camelCase", "snake_case", "SCREAMING_SNAKE_CASE", "kebab-case", "SCREAMING-KEBAB-CASE")


def _check(rule: str) -> None:
    if rule not in RULES:
        raise ValueError(f"there is no case rule {rule!r}; rules are {', '.join(RULES)}")


def _ascii(text: str, upper: bool) -> str:
    return "".join((c.upper() if upper else c.lower()) if c.isascii() else c for c in text)


def _words_joined(words: list[str]) -> str:
    return "".join(_ascii(w[:1], True) + w[1:] for w in words)


def field(name: str, rule: str) -> str:
    """A field's name, taken to be in snake case, under a rule."""
    _check(rule)
    if rule in ("lowercase", "snake_case"):
        return name
    if rule in ("UPPERCASE", "SCREAMING_SNAKE_CASE"):
        return _ascii(name, True)
    if rule in ("kebab-case", "SCREAMING-KEBAB-CASE"):
        return field(name, "snake_case" if rule[0] == "k" else "SCREAMING_SNAKE_CASE").replace("_", "-")
    pascal = _words_joined([w for w in name.split("_") if w])
    return pascal if rule == "PascalCase" else _ascii(pascal[:1], False) + pascal[1:]


def variant(name: str, rule: str) -> str:
    """A variant's name, taken to be in Pascal case, under a rule. Any upper-case letter begins a word; only ASCII letters change case."""
    _check(rule)
    if rule == "PascalCase":
        return name
    if rule in ("lowercase", "UPPERCASE"):
        return _ascii(name, rule[0] == "U")
    if rule == "camelCase":
        return _ascii(name[:1], False) + name[1:]
    snake = "".join(("_" if i and c.isupper() else "") + _ascii(c, False) for i, c in enumerate(name))
    if rule.startswith("SCREAMING"):
        snake = _ascii(snake, True)
    return snake.replace("_", "-") if "-" in rule else snake
