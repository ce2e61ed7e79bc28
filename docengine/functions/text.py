"""String functions: cleaning, slugs, paths, Markdown repair and checks.

All are Column expressions. White space means Unicode white space, spelled out
so that every regex engine reads the same class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docengine.functions.folding import ascii_fold, compat_fold, let

# White space, as regex class members and as plain characters.
WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS_NO_NEWLINE = r"\t\x{b}-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS_NO_BLANK = r"\t\x{b}-\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS_CHARS = "".join(
    chr(c)
    for c in [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WORD = r"\p{L}\p{N}_"


def strip(text: Column, chars: str = WS_CHARS) -> Column:
    return F.trim(text, F.lit(chars))


def rstrip(text: Column, chars: str = WS_CHARS) -> Column:
    return F.rtrim(text, F.lit(chars))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(~text.rlike(f"[^{WS}]"), F.lit(True))


def clean_text(text: Column) -> Column:
    """Drop the framework's empty comments, trim, squeeze white space."""
    bare = F.replace(text, F.lit("<!---->"), F.lit(""))
    return strip(F.regexp_replace(bare, f"[{WS}]+", " "))


def slugify(text: Column, allow_unicode: bool = False) -> Column:
    """Lower-case path component of at most 100 characters; empty stays empty."""
    base = F.coalesce(text, F.lit(""))
    folded = compat_fold(base) if allow_unicode else ascii_fold(base)
    word = WORD if allow_unicode else "0-9A-Za-z_"
    dashed = F.regexp_replace(folded, rf"[-{WS}_/\\]+", "-")
    kept = F.regexp_replace(dashed, rf"[^{word}\-.]", "")
    short = strip(F.lower(kept), "-_.")
    return let(
        short, lambda s: F.when(F.length(s) > 100, rstrip(F.substring(s, 1, 100), "-_.")).otherwise(s)
    )


def synthetic_id(text: Column) -> Column:
    """Stand-in id for an entry that has none."""
    words = F.regexp_replace(F.lower(text), rf"[^{WORD}{WS}-]", "")
    dashed = F.regexp_replace(F.regexp_replace(words, f"[{WS}]+", "-"), "-+", "-")
    return F.concat(F.lit("synthetic-"), strip(dashed, "-"))


def normalize_id(element_id: Column) -> Column:
    return strip(element_id, WS_CHARS + "-_")


def menu_folder(header: Column, menu: Column) -> Column:
    """Slug of the menu; null where it is blank or the same text as the header."""
    return F.when(header.isNull() | (menu != header), F.nullif(slugify(menu), F.lit("")))


def join_path(header_slug: Column, menu_slug: Column, text_slug: Column, base: str = "output") -> Column:
    """Path from slugs; null folders drop out."""
    name = let(text_slug, lambda s: F.when(s == "", F.lit("untitled")).otherwise(s))
    file = let(name, lambda s: F.when(s.endswith(".md"), s).otherwise(F.concat(s, F.lit(".md"))))
    return F.concat_ws("/", F.lit(base.rstrip("/")), header_slug, menu_slug, file)


def output_path(header: Column, menu: Column, text: Column, base: str = "output") -> Column:
    """``base/header/menu/text.md`` in slugs; blank parts and a menu equal to the header drop out."""
    return join_path(F.nullif(slugify(header), F.lit("")), menu_folder(header, menu), slugify(text), base)


def output_filename(text: Column, item_id: Column) -> Column:
    """Alternative file name ``<text>_<id>.md``."""
    kept = rstrip(F.regexp_replace(text, r"[^\p{L}\p{N} \-_]", ""))
    name = F.substring(F.replace(kept, F.lit(" "), F.lit("_")), 1, 50)
    return F.concat(name, F.lit("_"), F.coalesce(item_id, F.lit("None")), F.lit(".md"))


def raw_html_path(item_id: Column, base: str = "debug", kind: str = "html") -> Column:
    """Where the raw page of an item is kept."""
    return F.concat(F.lit(base.rstrip("/") + "/page_content_"), slugify(item_id), F.lit("." + kind))


# Clean-up rules in their order, in groups by what a text must hold
# for any rule of the group to apply (a regex, then a plain substring).
CLEANUP_GROUPS = [
    (
        r"[\x{ad}\x{61c}\x{1680}\x{2000}-\x{206f}\x{feff}]",
        [
            (r"[\x{200b}\x{200c}\x{200d}\x{feff}]+", ""),
            (r"[\x{201c}\x{201d}]", '"'),
            (r"[\x{2018}\x{2019}]", "'"),
            (r"[\x{2013}\x{2014}]", "--"),
            (r"[\x{ad}\x{61c}\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}]", ""),
        ],
    ),
    (None, [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]),
    ("](", [(rf"\[([^\]]+)\]\([{WS}]*\)", "$1")]),
    ("*", [(rf"\*\*[{WS}]*\*\*", "")]),
    ("_", [(rf"__[{WS}]*__", "")]),
    ("*", [(rf"\*[{WS}]*\*", "")]),
    ("_", [(rf"_[{WS}]*_", "")]),
]
CLEANUP_RULES = [rule for _, rules in CLEANUP_GROUPS for rule in rules]


def cleanup_patterns(text: Column) -> Column:
    """The clean-up rules; a cheap test first keeps most texts away from the regexes."""

    def apply(value: Column, rules: list, plain: bool) -> Column:
        for pattern, replacement in rules:
            if plain:
                value = F.replace(value, F.lit(pattern), F.lit(replacement))
            else:
                value = F.regexp_replace(value, pattern, replacement)
        return value

    def guarded(value: Column, needs: str | None, rules: list) -> Column:
        if needs is None:
            return apply(value, rules, True)
        present = value.rlike(needs) if needs.startswith("[") else value.contains(needs)
        return F.when(present, apply(value, rules, False)).otherwise(value)

    def chain(value: Column, groups: list) -> Column:
        if not groups:
            return value
        return chain(let(value, lambda v: guarded(v, *groups[0])), groups[1:])

    return chain(text, CLEANUP_GROUPS)


def fix_headers(text: Column) -> Column:
    """Put a blank after leading hashes that lack one."""

    def fix(t: Column) -> Column:
        spaced = F.regexp_replace(
            t, rf"(?dm)^([{WS_NO_NEWLINE}]*)(#+)[{WS_NO_BLANK}][{WS_NO_NEWLINE}]*", "$1$2 "
        )
        done = F.regexp_replace(spaced, rf"(?dm)^([{WS_NO_NEWLINE}]*)(#+)([^#{WS}])", "$1$2 $3")
        return F.when(t.contains("#"), done).otherwise(t)

    return let(text, fix)


def _table_separators(text: Column) -> Column:
    pattern = rf"\|[{WS}]*-+[{WS}]*\|"
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    dashes = F.transform(matches, lambda m: F.concat(F.lit("|"), F.repeat(F.lit("-"), F.length(m) - 2), F.lit("|")))
    gaps = F.split(text, pattern, -1)
    joined = F.array_join(
        F.zip_with(gaps, dashes, lambda gap, dash: F.concat(gap, F.coalesce(dash, F.lit("")))), ""
    )
    return F.when(text.contains("|"), joined).otherwise(text)


def _table_spacing(text: Column) -> Column:
    """Blank line before a table, and after the first line that follows one."""

    def is_table(line: Column) -> Column:
        return let(strip(line), lambda s: s.startswith("|") & s.endswith("|"))

    def spaced(lines: Column, table: Column) -> Column:
        def at(flags: Column, i: Column) -> Column:
            return (i >= 0) & F.coalesce(F.get(flags, i), F.lit(False))

        def filled(i: Column) -> Column:
            return (i >= 0) & ~is_blank(F.get(lines, i))

        def leaves(i: Column) -> Column:
            return ~at(table, i) & at(table, i - 1)

        def emit(line: Column, i: Column) -> Column:
            before = at(table, i) & ~at(table, i - 1) & filled(i - 1) & ~leaves(i - 1)
            after = leaves(i) & filled(i + 1)
            return F.concat(
                F.when(before, F.lit("\n")).otherwise(F.lit("")),
                line,
                F.when(after, F.lit("\n")).otherwise(F.lit("")),
            )

        return F.array_join(F.transform(lines, emit), "\n")

    done = let(F.split(text, "\n", -1), lambda lines: let(F.transform(lines, is_table), lambda t: spaced(lines, t)))
    return F.when(text.contains("|"), done).otherwise(text)


def clean_md_tables(text: Column) -> Column:
    return let(let(text, _table_separators), _table_spacing)


def normalize_ws(text: Column, tab: int = 4) -> Column:
    """Tabs to the next stop, then no trailing white space on any line."""

    def expand(line: Column) -> Column:
        def step(done: Column, part: Column) -> Column:
            column = F.length(F.substring_index(done, "\r", -1))
            return F.concat(done, F.repeat(F.lit(" "), tab - column % tab), part)

        parts = F.split(line, "\t", -1)
        stops = let(
            parts, lambda p: F.aggregate(F.slice(p, F.lit(2), F.size(p) - 1), F.get(p, F.lit(0)), step)
        )
        return F.when(line.contains("\t"), stops).otherwise(line)

    def expand_all(t: Column) -> Column:
        lines = F.array_join(F.transform(F.split(t, "\n", -1), expand), "\n")
        return F.when(t.contains("\t"), lines).otherwise(t)

    expanded = let(text, expand_all)
    # Starts only at the first of a run of blanks, so long runs cost no more than short ones.
    blanks = f"[{WS_NO_NEWLINE}]"
    return F.regexp_replace(expanded, rf"(?<!{blanks}){blanks}++(?=\n|\z)", "")


def squeeze_blank(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def sanitize(
    text: Column,
    headers: bool = True,
    tables: bool = True,
    whitespace: bool = True,
    blank_lines: bool = True,
) -> Column:
    """The whole Markdown clean-up; blank or null content becomes the empty string."""

    def clean(t: Column) -> Column:
        done = cleanup_patterns(t)
        if headers:
            done = fix_headers(done)
        if tables:
            done = clean_md_tables(done)
        if whitespace:
            done = normalize_ws(done)
        if blank_lines:
            done = squeeze_blank(done)
        return F.when(is_blank(t), F.lit("")).otherwise(strip(done))

    return let(text, clean)


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def fix_code_blocks(text: Column) -> Column:
    """Close open fenced blocks and set blank lines around fences."""
    closed = F.regexp_replace(text, r"(?dms)^```([^`\n]*)\n(.*?)\n(?!```)$", "```$1\n$2\n```")
    before = F.regexp_replace(closed, r"(\n```[^\n]*\n)", "\n$1")
    return F.regexp_replace(before, r"(\n```\n)", "$1\n")


def setext_to_atx(text: Column) -> Column:
    """Underlined headings to hash headings.

    A run of underlines below one line leaves one heading: the last underline of
    the run decides, together with the line right above it.
    """

    def build(lines: Column) -> Column:
        def underline(i: Column) -> Column:
            above = strip(F.get(lines, i - 1))
            return (i > 0) & F.get(lines, i).rlike(rf"^[{WS}]*[=\-]+[{WS}]*\z") & (above != "") & ~above.startswith("#")

        kept = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: ~underline(i))

        def emit(index: Column) -> Column:
            def one(i: Column, n: Column) -> Column:
                last = F.coalesce(F.get(index, n + 1), F.size(lines)) - 1
                marks = F.when(F.get(lines, last).contains("="), F.lit("# ")).otherwise(F.lit("## "))
                return F.when(last > i, F.concat(marks, strip(F.get(lines, last - 1)))).otherwise(F.get(lines, i))

            return F.array_join(F.transform(index, one), "\n")

        return let(kept, emit)

    return let(F.split(text, "\n", -1), build)


def _count(text: Column, mark: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def md_checks(text: Column) -> Column:
    """Five structure checks as one struct of booleans."""

    def balanced(t: Column, mark: str) -> Column:
        double = _count(t, mark * 2)
        return (double % 2 == 0) & ((_count(t, mark) - double * 2) % 2 == 0)

    def clean_row(line: Column) -> Column:
        return let(strip(line), lambda s: ~s.contains("|") | (s.startswith("|") & s.endswith("|")))

    def all_checks(t: Column) -> Column:
        return F.struct(
            t.rlike(rf"(?dm)^#+[{WS}]+[^\n]").alias("has_headers"),
            (F.regexp_count(t, F.lit("(?dm)^```")) % 2 == 0).alias("has_proper_code_blocks"),
            (balanced(t, "*") & balanced(t, "_")).alias("has_balanced_emphasis"),
            (~t.rlike(rf"\[([^\]]+)\]\([{WS}]*\)")).alias("has_valid_links"),
            (~t.contains("|") | F.forall(F.split(t, "\n", -1), clean_row)).alias("has_clean_tables"),
        )

    return let(text, all_checks)


def one_decimal(value: Column) -> Column:
    """A non-negative double with one decimal, rounded as C and Python print it: the
    exact binary value decides, and an exact tie goes to the even digit. (Java's
    formatter rounds the shortest decimal form half up.)"""

    def tenths(fraction: Column) -> Column:
        scaled = fraction * 2.0**50
        whole = F.floor(scaled)
        digit = F.floor(whole * 10 / F.lit(2.0**50))
        over = (whole * 10 - digit * 2**50 - 2**49).cast("double") + (scaled - whole) * 10
        return digit + F.when((over > 0) | ((over == 0) & (digit % 2 == 1)), 1).otherwise(0)

    total = F.floor(value) * 10 + tenths(value - F.floor(value))
    return let(total, lambda t: F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string")))


def checksum(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in hex."""
    return F.sha2(text, 256)


def content_length(text: Column) -> Column:
    return F.length(text)


def has_breadcrumbs(crumbs: Column) -> Column:
    return F.coalesce(F.size(crumbs) > 0, F.lit(False))


def iso_time(text: Column) -> Column:
    """Parse an ISO time; what does not parse becomes null."""
    return F.try_to_timestamp(text)


def endpoint_version(url: Column, default: str = "4.6") -> Column:
    found = F.regexp_extract(url, r"/versions/([0-9]+\.[0-9]+)/", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(default))
