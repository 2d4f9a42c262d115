"""Settings from text, as environments and files give them: read, checked, and with defaults."""

from __future__ import annotations

from collections.abc import Mapping

TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


class Settings:
    """Typed reads of named values; an empty value counts as none. A value that can't be read is an error that names it."""

    def __init__(self, values: Mapping[str, str]):
        self.values = values

    def text(self, name: str, default: str = "") -> str:
        return (self.values.get(name) or "").strip() or default

    def _read(self, name: str, default, kind, what: str):
        raw = self.text(name)
        try:
            return kind(raw) if raw else default
        except (ValueError, KeyError):
            raise ValueError(f"{name} must be {what}, not {raw!r}") from None

    def whole(self, name: str, default: int) -> int:
        return self._read(name, default, int, "a whole number")

    def number(self, name: str, default: float) -> float:
        return self._read(name, default, float, "a number")

    def flag(self, name: str, default: bool) -> bool:
        return self._read(name, default, lambda x: {**dict.fromkeys(TRUE, True), **dict.fromkeys(FALSE, False)}[x.lower()], "yes or no")

    def names(self, name: str, default: tuple[str, ...] = ()) -> tuple[str, ...]:
        return tuple(x.strip() for x in self.text(name).split(",") if x.strip()) or default


def feed_url(template: str, version: str, segment: str) -> str:
    """The address of a segment's archive; a template without its place for one is an error."""
    if "{segment}" not in template:
        raise ValueError("the feed's address needs a place for {segment}")
    return template.replace("{version}", version).replace("{segment}", segment)
