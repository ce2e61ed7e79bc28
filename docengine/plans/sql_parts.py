"""Shared pieces of the check SQL."""

from __future__ import annotations

from docengine.functions.text import WS, WS_CHARS

W = f"[{WS}]"
WN = r"[\t\x{b}-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WN_NO_BLANK = r"[\t\x{b}-\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CHARS = WS_CHARS.replace("'", "''")


def sub(text: str, pattern: str, replacement: str) -> str:
    quoted = [p.replace("'", "''") for p in (pattern, replacement)]
    return f"regexp_replace({text}, '{quoted[0]}', '{quoted[1]}', 'g')"


def strip(text: str, chars: str = CHARS) -> str:
    return f"trim({text}, '{chars}')"


def rstrip(text: str, chars: str = CHARS) -> str:
    return f"rtrim({text}, '{chars}')"


def clean(text: str) -> str:
    return strip(sub(f"replace({text}, '<!---->', '')", f"{W}+", " "))


def slug(text: str) -> str:
    folded = sub(f"strip_accents(coalesce({text}, ''))", r"[^\x{0}-\x{7f}]", "")
    dashed = sub(folded, rf"[-{WS}_/\\]+", "-")
    short = f"trim(lower({sub(dashed, r'[^0-9A-Za-z_.-]', '')}), '-_.')"
    return f"(CASE WHEN length({short}) > 100 THEN rtrim(left({short}, 100), '-_.') ELSE {short} END)"


def path(header: str, menu: str, text: str, base: str = "output") -> str:
    name = f"(CASE WHEN {slug(text)} = '' THEN 'untitled' ELSE {slug(text)} END)"
    menu_part = f"CASE WHEN {header} IS NULL OR {menu} <> {header} THEN nullif({slug(menu)}, '') END"
    return (
        f"concat_ws('/', '{base}', nullif({slug(header)}, ''), {menu_part}, "
        f"CASE WHEN {name} LIKE '%.md' THEN {name} ELSE {name} || '.md' END)"
    )


def any_of(text: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{p}')" for p in phrases) + ")"


def blank(text: str) -> str:
    return f"coalesce({strip(text)} = '', true)"


def filled(text: str) -> str:
    return f"coalesce({text} <> '', false)"
