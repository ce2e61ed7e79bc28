"""Page content to Markdown.

One Python call parses a page and turns the nodes that any strategy may ask for into
Markdown; Spark then finds the strategy, picks nodes and puts their pieces together.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.html import content_parser
from docengine.functions.text import let
from docengine.operators.nodes import DEFAULT, Profile, first, has_class, inside, is_tag, shown_text

# Element names and words of the content layout.
ENDPOINT, MODEL, MARKDOWN = "app-api-doc-endpoint", "app-api-doc-model", "markdown"
CONTAINER_WORDS = "content|doc|api|main"
LEAST_FALLBACK = 50


# Elements of an endpoint page that become Markdown.
ENDPOINT_PARTS = frozenset(["app-api-doc-security", "app-api-doc-server", "app-show-parameters", "app-api-doc-response", "app-api-doc-request-body"])


def _asked(profile: Profile):
    """The nodes of a page that its strategy may convert, see ``content_parser``."""

    def below(nodes, node):
        return nodes[node.node_id + 1 : node.last_id + 1]

    def role(node, tag: str, name: str) -> bool:
        return node.tag == tag and node.attrs.get("role") == name

    def parts(nodes, endpoint) -> dict[int, bool]:
        found = {}
        for n in below(nodes, endpoint):
            if role(n, "div", "tabpanel"):
                found[n.node_id] = True
            elif n.tag in ENDPOINT_PARTS:
                # A response with tabs is taken apart, tab by tab.
                tabs = sum(role(x, "button", "tab") for x in below(nodes, n)) if n.tag == "app-api-doc-response" else 0
                if tabs < 2:
                    found[n.node_id] = False
        return found

    def containers(scope) -> dict[int, bool]:
        words = re.compile(CONTAINER_WORDS)
        wide = [n for n in scope if n.tag in ("div", "section", "article")]
        return {n.node_id: True for n in wide if any(words.search(c.lower()) for c in n.attrs.get("class", "").split())}

    def asked(nodes) -> dict[int, bool]:
        pane = next((n for n in nodes if n.attrs and n.attrs.get("id") == profile.content_id), None)
        scope = below(nodes, pane) if pane else nodes
        firsts: dict[str, object] = {}
        for n in scope:
            firsts.setdefault(n.tag, n)
        if ENDPOINT in firsts:
            return parts(nodes, firsts[ENDPOINT])
        outside = next((n for n in nodes if n.tag == ENDPOINT), None) if pane else None
        found = parts(nodes, outside) if outside else {}
        if MODEL in firsts:
            return found | {firsts[MODEL].node_id: False}
        if MARKDOWN in firsts:
            return found | {n.node_id: True for n in scope if n.tag == MARKDOWN}
        return found | (containers(scope) or {-1: True})

    return asked


@lru_cache(maxsize=8)
def _parser(profile: Profile):
    return content_parser(_asked(profile))


def with_content(pages: DataFrame, html: str = "html", profile: Profile = DEFAULT) -> DataFrame:
    """Add ``nodes`` (with the Markdown of those a strategy may ask for), ``whole`` and ``parse_error``; pages without HTML drop out."""
    parsed = pages.filter(F.length(html) > 0).withColumn("_page", _parser(profile)(F.col(html)))
    found = {"nodes": F.col("_page.nodes"), "whole": F.col("_page.whole"), "parse_error": F.col("_page.error")}
    return parsed.withColumns(found).drop("_page")


def _scope(nodes: Column, p: Profile) -> Column:
    """Nodes of the content pane, or all of them where the page is the pane."""
    pane = first(F.filter(nodes, lambda n: n["dom_id"] == p.content_id))
    return let(pane, lambda n: F.when(n.isNotNull(), inside(nodes, n)).otherwise(nodes))


def _find(scope: Column, *tags: str) -> Column:
    return first(F.filter(scope, lambda n: is_tag(n, *tags)))


def _under(nodes: Column, node: Column, test) -> Column:
    """First match below ``node``; null where ``node`` is null."""
    return first(F.filter(inside(nodes, node), test))


def content_strategy(scope: Column) -> Column:
    def has(tag: str) -> Column:
        return F.exists(scope, lambda n: is_tag(n, tag))

    return (
        F.when(has(ENDPOINT), F.lit("endpoint"))
        .when(has(MODEL), F.lit("model"))
        .when(has(MARKDOWN), F.lit("markdown"))
        .otherwise(F.lit("fallback"))
    )


def with_strategy(parsed: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    return parsed.withColumn("strategy", content_strategy(_scope(F.col("nodes"), profile)))


# --- endpoint pieces that are plain text ------------------------------------------


def endpoint_header(nodes: Column, endpoint: Column) -> Column:
    """``### METHOD Title Try It``, each part only where present."""

    def text_of(node: Column) -> Column:
        return let(node, lambda n: F.when(n.isNotNull(), shown_text(nodes, n)))

    def build(head: Column) -> Column:
        method = let(
            _under(nodes, head, lambda n: is_tag(n, "app-show-http-method")),
            lambda m: text_of(
                _under(nodes, m, lambda n: is_tag(n, "span") & F.exists(n["classes"], lambda c: c.contains("http-method")))
            ),
        )
        title = text_of(_under(nodes, head, lambda n: is_tag(n, "span") & has_class(n, "dds__pl-3")))
        button = _under(nodes, head, lambda n: is_tag(n, "button") & _only_text(nodes, n, "Try It"))
        parts = F.array_compact(F.array(method, title, F.when(button.isNotNull(), F.lit("Try It"))))
        return let(parts, lambda p: F.when(F.size(p) > 0, F.concat(F.lit("### "), F.array_join(p, " "))))

    return let(_under(nodes, endpoint, lambda n: is_tag(n, "div") & has_class(n, "dds__mb-4")), build)


def _only_text(nodes: Column, node: Column, text: str) -> Column:
    """The element holds one text node, directly or through only children, equal to ``text``."""
    below = inside(nodes, node)
    texts = F.filter(below, lambda n: is_tag(n, "#text"))
    chain = F.forall(below, lambda n: n["child_ord"] == 0)
    return chain & (F.size(texts) == 1) & (first(texts)["data"] == text)


def endpoint_path(nodes: Column, endpoint: Column) -> Column:
    block = _under(nodes, endpoint, lambda n: is_tag(n, MARKDOWN))
    pre = let(block, lambda b: _under(nodes, b, lambda n: is_tag(n, "pre")))
    text = let(pre, lambda n: F.when(n.isNotNull(), F.nullif(shown_text(nodes, n), F.lit(""))))
    return F.concat(F.lit("```\n"), text, F.lit("\n```"))


def same_subtree(nodes: Column, a: Column, b: Column) -> Column:
    """Both elements have the same tag, attributes, places and texts, all the way down."""

    def shape(n: Column) -> Column:
        whole = F.slice(nodes, n["node_id"] + 1, n["last_id"] - n["node_id"] + 1)
        return F.transform(
            whole,
            lambda x: F.struct(
                x["tag"], (x["depth"] - n["depth"]).alias("depth"), F.when(x["node_id"] != n["node_id"], x["child_ord"]).alias("at"), F.array_sort(F.map_entries(x["attrs"])).alias("attrs"),
                F.when(x["tag"].startswith("#"), x["data"]).alias("data"),
            ),
        )

    return shape(a) == shape(b)


def endpoint_description(nodes: Column, endpoint: Column) -> Column:
    """Text of the description block, unless that block equals the path block as an element."""
    path = _under(nodes, endpoint, lambda n: is_tag(n, MARKDOWN))
    box = _under(nodes, endpoint, lambda n: is_tag(n, "div") & has_class(n, "dds__mt-2"))
    block = let(box, lambda b: _under(nodes, b, lambda n: is_tag(n, MARKDOWN)))

    def text(b: Column, p: Column) -> Column:
        # The path block comes first or is the description block itself, so it is there whenever the other is.
        same = (b["node_id"] == p["node_id"]) | same_subtree(nodes, b, p)
        return F.when(b.isNotNull() & ~same, F.nullif(shown_text(nodes, b), F.lit("")))

    return let(block, lambda b: let(path, lambda p: text(b, p)))


# --- pieces of converted nodes ----------------------------------------------------------------


def _piece(markdown: Column, kind: str, label: Column | None = None) -> Column:
    return F.struct(
        markdown.alias("markdown"), F.lit(kind).alias("kind"), (label if label is not None else F.lit(None).cast("string")).alias("label")
    )


def _pieces(found: Column, kind: str) -> Column:
    return F.transform(found, lambda n: _piece(n["markdown"], kind))


def response_pieces(nodes: Column, response: Column) -> Column:
    """One piece per tab with its panel, or one for the whole response."""

    def role(tag: str, name: str) -> Column:
        return F.filter(inside(nodes, response), lambda n: is_tag(n, tag) & (n["attrs"]["role"] == name))

    def per_tab(tabs: Column, panels: Column) -> Column:
        pairs = F.zip_with(tabs, panels, lambda t, q: _piece(q["markdown"], "tab", F.when(t.isNotNull(), shown_text(nodes, t))))
        paired = F.filter(pairs, lambda r: r["markdown"].isNotNull() & r["label"].isNotNull())
        whole = F.array(_piece(response["markdown"], "response"))
        return F.when(response.isNull(), F.slice(whole, 1, 0)).when(F.size(tabs) > 1, paired).otherwise(whole)

    return let(role("button", "tab"), lambda t: let(role("div", "tabpanel"), lambda q: per_tab(t, q)))


def endpoint_pieces(nodes: Column, endpoint: Column) -> Column:
    """Pieces of an endpoint page in output order."""
    below = inside(nodes, endpoint)

    def one(tag: str, kind: str, test=None) -> Column:
        found = F.slice(F.filter(below, lambda n: is_tag(n, tag)), 1, 1)
        if test is not None:
            found = F.filter(found, test)
        return _pieces(found, kind)

    response = first(F.filter(below, lambda n: is_tag(n, "app-api-doc-response")))
    return F.concat(
        one("app-api-doc-security", "security", lambda n: shown_text(nodes, n) != ""),
        one("app-api-doc-server", "server"),
        _pieces(F.filter(below, lambda n: is_tag(n, "app-show-parameters")), "parameters"),
        let(response, lambda r: response_pieces(nodes, r)),
        one("app-api-doc-request-body", "request_body"),
    )


def fallback_pieces(scope: Column, whole: Column) -> Column:
    """Containers with a telling class, nested ones included; else the whole page."""
    containers = F.filter(
        scope,
        lambda n: is_tag(n, "div", "section", "article")
        & F.exists(n["classes"], lambda c: F.lower(c).rlike(CONTAINER_WORDS)),
    )
    return let(containers, lambda c: F.when(F.size(c) > 0, _pieces(c, "fallback")).otherwise(F.array(_piece(whole, "fallback"))))


def _format(piece: Column) -> Column:
    text = piece["markdown"]
    return (
        F.when(text == "", F.lit(None))
        .when(piece["kind"] == "security", F.concat(F.lit("## Security\n\n"), text))
        .when(piece["kind"] == "tab", F.concat(F.lit("### Response "), piece["label"], F.lit("\n\n"), text))
        .when(piece["kind"] == "fallback", F.when(F.length(text) > LEAST_FALLBACK, text))
        .otherwise(text)
    )


def _formatted(pieces: Column) -> Column:
    """(kind, markdown) of each piece, empty ones left out."""
    done = F.transform(pieces, lambda p: F.struct(p["kind"].alias("kind"), _format(p).alias("markdown")))
    return F.filter(done, lambda p: p["markdown"].isNotNull())


def endpoint_parts(parsed: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Header, path, description and converted pieces of every endpoint page of ``with_content``."""
    nodes, endpoint = F.col("nodes"), F.col("_endpoint")
    pages = parsed.withColumn("_endpoint", _find(nodes, ENDPOINT)).filter(endpoint.isNotNull())
    texts = {"header": endpoint_header, "path": endpoint_path, "description": endpoint_description}
    return pages.select(
        *keys, *[make(nodes, endpoint).alias(name) for name, make in texts.items()], _formatted(endpoint_pieces(nodes, endpoint)).alias("pieces")
    )


def pieces_of(pieces: Column, *kinds: str) -> Column:
    """Markdown of the pieces of some kinds, in order."""
    return F.transform(F.filter(pieces, lambda p: p["kind"].isin(*kinds)), lambda p: p["markdown"])


def page_content(parsed: DataFrame, keys: tuple[str, ...] = ("page_id",), profile: Profile = DEFAULT) -> DataFrame:
    """Markdown of every page of ``with_content`` by its strategy; pages without content give the empty string."""
    nodes = F.col("nodes")
    scoped = with_strategy(parsed.withColumn("_scope", _scope(nodes, profile)), profile)
    scope, kind = F.col("_scope"), F.col("strategy")

    def endpoint_texts(e: Column) -> Column:
        lead = F.array_compact(F.array(endpoint_header(nodes, e), endpoint_path(nodes, e), endpoint_description(nodes, e)))
        return F.concat(lead, texts(endpoint_pieces(nodes, e)))

    def texts(pieces: Column) -> Column:
        return F.transform(_formatted(pieces), lambda p: p["markdown"])

    found = (
        F.when(kind == "endpoint", let(_find(scope, ENDPOINT), endpoint_texts))
        .when(kind == "model", texts(_pieces(F.slice(F.filter(scope, lambda n: is_tag(n, MODEL)), 1, 1), "model")))
        .when(kind == "markdown", texts(_pieces(F.filter(scope, lambda n: is_tag(n, MARKDOWN)), "markdown")))
        .otherwise(texts(fallback_pieces(scope, F.col("whole"))))
    )
    return scoped.select(*keys, "strategy", F.array_join(found, "\n\n").alias("markdown"))


def rendered(rows: DataFrame, html: str = "html", profile: Profile = DEFAULT) -> DataFrame:
    """Rows of pages with ``markdown`` in the place of their HTML; the ``render`` of the publishing functions."""
    return page_content(with_content(rows, html, profile), tuple(c for c in rows.columns if c != html), profile).drop("strategy")
