"""HTML read natively: one split into tokens feeds text, code, links, title and metadata alike.

``tokens`` follows the states of the standard's tokenizer: text, tag, attribute,
quoted value, raw text and comment. A ``<`` that opens none of these is text, and
a ``>`` inside a quoted value does not end its tag. All that looks at a page then
works on the array of tokens, in time linear in its length.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.lets import let
from docloom.functions.text import squash, strip

# Names of all character references, the usual ones first: a lookup walks the map in order.
_USUAL = ("amp", "nbsp", "lt", "gt", "quot", "apos", "copy", "mdash", "ndash", "rsquo", "lsquo", "hellip", "middot")
_NAMED = {name[:-1]: chars for name, chars in html5.items() if name.endswith(";")} | {"nbsp": " "}
ENTITIES = {name: _NAMED[name] for name in dict.fromkeys((*_USUAL, *sorted(_NAMED)))}
# Names that count without a semicolon as well, the longest first.
LOOSE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
# Numbers 128 to 159 stand for the characters of Windows code page 1252, where it has one.
CP1252 = {n: bytes([n]).decode("cp1252") for n in range(128, 160) if bytes([n]).decode("cp1252", "ignore")}

# One attribute; a value may be quoted, bare or missing.
_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""
# Attributes of a tag. Beyond 400 of them, which no page has, a tag ends at the next ``>`` whatever quotes there are.
_ATTRIBUTES = rf"(?:[\s/]++|{_ATTRIBUTE}){{0,800}}+[^>]*+>"
TAG = rf"</?[A-Za-z][^\s/>]*+{_ATTRIBUTES}"
# Comments, also those that end early or never, declarations, and tags that are none.
_COMMENT = r"<!--(?:-?+>|.*?(?:--!?>|\z))"
# A last tag that is never closed is text, and is taken whole.
_UNCLOSED = r"<(?=[A-Za-z/!?])[^>]*+\z"
_NO_TAG = r"<[!?][^>]*+>|</(?:[^A-Za-z>][^>]*+)?>"
# Elements whose content is no markup, and code, whose white space counts; each is one token with its content,
# which goes on to the end of the page if it is never closed.
_WHOLE = ("script", "style", "title", "textarea", "pre")
_ELEMENT = rf"<({'|'.join(_WHOLE)})(?=[\s/>]){_ATTRIBUTES}(?:.*?</\1(?=[\s/>])[^>]*+>|.*+)"
TOKEN = rf"(?is){_COMMENT}|{_UNCLOSED}|{_NO_TAG}|{_ELEMENT}|{TAG}|[^<]++|<"

UNSEEN = ("head", "noscript", "template", "svg")
SIDE_PARTS = ("nav", "header", "footer", "aside", "form")
BLOCKS = (
    "html body main article section header footer nav aside form div p ul ol dl dt dd table thead tbody tr td th"
    " blockquote figure figcaption address h1 h2 h3 h4 h5 h6 pre li hr"
).split()

MIN_WORDS = 10
MAX_LINK_SHARE = 0.5
# A block's score: the share of text in it, the share of that outside links, and how apt its tag is for prose.
TEXT_WEIGHT, PLAIN_WEIGHT, TAG_WEIGHT = 0.5, 0.3, 0.2
THRESHOLD = 0.5
TAGS = dict.fromkeys(("p", "blockquote", "article", "main", "section", "dd"), 1.0) | dict.fromkeys(
    ("h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dt", "figcaption"), 0.75
)
OTHER_TAG = 0.5
# Code is between these in joined text; pages do not hold them.
OPENED, CLOSED = "\x01", "\x02"


# --- character references --------------------------------------------------------------


def _decoded(piece: Column, attribute: bool) -> Column:
    """What follows an ``&``: a number or name, with or without ``;``, and the rest → the character and the rest."""
    number = F.regexp_extract(piece, r"^(#(?:0*[0-9]{1,7}(?![0-9])|[xX]0*[0-9a-fA-F]{1,6}(?![0-9a-fA-F]));?)", 1)
    digits = F.regexp_replace(number, "[#xX;]", "")
    point = F.when(number.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
    valid = (point > 0) & (point < 0x110000) & ~point.between(0xD800, 0xDFFF)
    moved = F.element_at(F.from_json(F.lit(json.dumps(CP1252)), "map<string,string>"), point.cast("string"))
    char = F.coalesce(moved, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
    # One literal, folded when the plan is made.
    names = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")
    name = F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]*);", 1)
    # In an attribute, a name without semicolon counts only if no word or value goes on there.
    loose = F.regexp_extract(piece, rf"^({'|'.join(LOOSE)}){'(?![=A-Za-z0-9])' if attribute else ''}", 1)

    def rest(taken: Column) -> Column:
        return F.substring(piece, F.length(taken) + 1, F.length(piece))

    exact = F.when(name != "", F.element_at(names, name))
    return (
        F.when((number != "") & valid, F.concat(char, rest(number)))
        .when(exact.isNotNull(), F.concat(exact, F.substring(piece, F.length(name) + 2, F.length(piece))))
        .when(loose != "", F.concat(F.element_at(names, loose), rest(loose)))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def unescape(text: Column, attribute: bool = False) -> Column:
    """Numbered and named character references as characters, each decoded once; others stay."""
    pieces = F.transform(F.split(text, "&"), lambda p, i: F.when(i == 0, p).otherwise(_decoded(p, attribute)))
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


# --- tokens ----------------------------------------------------------------------------


def tokens(html: Column) -> Column:
    """The page as an array of texts, tags, comments and whole elements, which join to the page again."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def is_text(token: Column) -> Column:
    """A text, or a ``<`` that opens nothing; no tag, comment or element."""
    return ~F.startswith(token, F.lit("<")) | token.rlike(r"^<(?!!--)[^>]*+$")


def _is_tag(token: Column) -> Column:
    """A tag; no text, comment or element without markup."""
    return token.rlike("^</?[A-Za-z]") & ~token.rlike(r"(?i)^<(?:script|style|title)(?=[\s/>])")


def tag_name(token: Column) -> Column:
    """Lower-case name of a tag, with a slash before that of an end tag; empty for all else."""
    return F.lower(F.regexp_extract(token, r"^<(/?[A-Za-z][^\s/>]*+)", 1))


def attribute(tag: Column, name: str) -> Column:
    """Decoded value of a tag's first attribute ``name``; empty if it has no value, NULL if it is not there."""
    after = F.regexp_replace(tag, r"^</?[A-Za-z][^\s/>]*+", "")
    held = F.filter(
        F.regexp_extract_all(after, F.lit(rf"(?s){_ATTRIBUTE}"), F.lit(0)),
        lambda a: F.lower(F.regexp_extract(a, r"^([^\s/>][^\s/>=]*+)", 1)) == name,
    )
    raw = F.regexp_extract(F.get(held, F.lit(0)), r"(?s)^[^=]*+=\s*+(.*)$", 1)
    bare = F.regexp_replace(raw, r"""(?s)^"(.*)"$|^'(.*)'$""", "$1$2")
    return let(bare, lambda value: unescape(value, attribute=True))


def inside(element: Column) -> Column:
    """Content of a whole element's token."""
    return F.regexp_replace(F.regexp_replace(element, rf"(?is)^<[a-z]++{_ATTRIBUTES}", ""), r"(?is)</[a-z]++[^>]*+>$", "")


def without(toks: Column, names: Sequence[str]) -> Column:
    """Tokens outside of the elements ``names``, however these nest; one that is never closed hides nothing.

    Only the tags of these elements are folded, to the ranges that stay.
    """
    # The body closes a head that was left open.
    listed = "|".join([*names, *(["body"] if "head" in names else [])])
    places = F.filter(
        F.transform(toks, lambda t, i: F.when(t.rlike(rf"(?i)^</?(?:{listed})(?=[\s/>])"), i + 1).otherwise(0)), lambda i: i > 0
    )
    named = F.transform(
        places,
        lambda at: F.struct(
            at.alias("at"),
            F.when(~F.element_at(toks, at).rlike(r"(?is)^<svg.*/>$"), tag_name(F.element_at(toks, at))).alias("name"),
        ),
    )
    bodies = lambda m: F.struct(m["at"].alias("at"), F.when(m["name"] == "body", "/head").otherwise(m["name"]).alias("name"))
    marks = F.transform(F.filter(named, lambda m: m["name"].isNotNull()), bodies)
    span = "struct<first:int,last:int>"
    state = f"struct<depth:int,name:string,opened:int,first:int,kept:array<{span}>>"

    def step(s: Column, m: Column) -> Column:
        opens = (s["depth"] == 0) & ~F.startswith(m["name"], F.lit("/"))
        deeper = (s["depth"] > 0) & (m["name"] == s["name"])
        back = (s["depth"] > 0) & (m["name"] == F.concat(F.lit("/"), s["name"]))
        ends = back & (s["depth"] == 1)
        return F.struct(
            F.when(opens | deeper, s["depth"] + 1).when(back, s["depth"] - 1).otherwise(s["depth"]).alias("depth"),
            F.when(opens, m["name"]).otherwise(s["name"]).alias("name"),
            F.when(opens, m["at"]).otherwise(s["opened"]).alias("opened"),
            F.when(ends, m["at"] + 1).otherwise(s["first"]).alias("first"),
            F.when(ends, F.array_append(s["kept"], F.struct(s["first"].alias("first"), (s["opened"] - 1).alias("last"))))
            .otherwise(s["kept"]).alias("kept"),
        ).cast(state)

    start = F.struct(
        F.lit(0).alias("depth"), F.lit("").alias("name"), F.lit(0).alias("opened"), F.lit(1).alias("first"),
        F.array().cast(f"array<{span}>").alias("kept"),
    ).cast(state)
    end = lambda s: F.array_append(s["kept"], F.struct(s["first"].alias("first"), F.size(toks).alias("last")))
    ranges = F.aggregate(marks, start, step, end)
    return F.when(F.size(marks) == 0, toks).otherwise(
        F.flatten(F.transform(ranges, lambda r: F.slice(toks, r["first"], F.greatest(r["last"] - r["first"] + 1, F.lit(0)))))
    )


def shown(html: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a page's tokens without those that no reader sees."""
    return let(tokens(html), lambda all_: let(without(all_, UNSEEN), body))


# --- text ------------------------------------------------------------------------------


def _flow_marks() -> Column:
    """What a tag becomes in the text, by its name; all other tags vanish."""
    marks = {name: "\n\n" for block in BLOCKS for name in (block, f"/{block}")}
    marks |= {f"h{level}": "\n\n" + "#" * level + " " for level in range(1, 7)}
    marks |= {"br": "\n", "/br": "\n", "li": "\n* ", "/li": "", "pre": "\n```\n", "/pre": "\n```\n", "code": "`", "/code": "`"}
    return F.from_json(F.lit(json.dumps(marks)), "map<string,string>")


def page_text(html: Column) -> Column:
    """Full text of a page: headings, list items and code kept as marks, links as their words.

    White space inside ``pre`` stays as it is, between fences.
    """
    joined = shown(F.translate(html, OPENED + CLOSED, ""), lambda t: F.array_join(F.transform(t, _written), ""))
    # Text and code by turns; there is one more text than there are codes.
    parts = F.transform(F.split(joined, f"[{OPENED}{CLOSED}]"), lambda p, i: F.when(i % 2 == 0, _flow(p)).otherwise(_fence(p)))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")


def _written(token: Column) -> Column:
    """A token as it stands in the text."""
    code = F.concat(F.lit(OPENED), _markless(inside(token)), F.lit(CLOSED))
    return (
        F.when(is_text(token), unescape(token))
        .when(token.rlike(r"(?i)^<pre(?=[\s/>])"), code)
        .when(token.rlike(r"(?is)^<textarea(?=[\s/>])"), unescape(inside(token)))
        .when(_is_tag(token), F.coalesce(F.element_at(_flow_marks(), tag_name(token)), F.lit("")))
        .otherwise("")
    )


def _markless(markup: Column) -> Column:
    """Code without the tags in it, line breaks but kept."""
    return F.array_join(
        F.transform(
            tokens(markup),
            lambda t: F.when(is_text(t), unescape(t)).when(t.rlike(r"(?i)^<br(?=[\s/>])"), "\n").otherwise(""),
        ),
        "",
    )


def _fence(code: Column) -> Column:
    """Code as written between fences."""
    body = F.regexp_replace(F.regexp_replace(code, r"^\r?\n", ""), r"\s+$", "")
    return F.when(body == "", "").otherwise(F.concat(F.lit("```\n"), body, F.lit("\n```")))


def _flow(text: Column) -> Column:
    """White space of text outside ``pre``."""
    out = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    out = F.regexp_replace(out, r" ?\n ?", "\n")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def words_of(toks: Column) -> Column:
    """Words of a piece of markup on one line."""
    return squash(F.array_join(F.transform(toks, lambda t: F.when(is_text(t), unescape(t)).otherwise("")), ""))


def page_text_pruned(html: Column) -> Column:
    """Text without side parts, and without blocks that are short, mostly links, or not dense enough.

    A block is what stands between two block tags. It needs ``MIN_WORDS`` words, at most
    ``MAX_LINK_SHARE`` of its text in links, and a score of text density, plain text and
    tag that reaches the page's own threshold: ``THRESHOLD``, halved for a page that
    is all markup and half as high again for one that is all text.
    """
    return shown(html, lambda t: let(without(t, SIDE_PARTS), _dense))


def _dense(toks: Column) -> Column:
    listed = "|".join(BLOCKS)
    seen = F.transform(toks, lambda t: F.when(t.rlike(r"(?i)^<pre(?=[\s/>])"), F.lit("<pre>")).otherwise(t))
    places = F.filter(
        F.transform(seen, lambda t, i: F.when(t.rlike(rf"(?i)^</?(?:{listed})(?=[\s/>])"), i + 1).otherwise(0)), lambda i: i > 0
    )
    return let(places, lambda p: _scored_blocks(toks, p))


def _scored_blocks(toks: Column, places: Column) -> Column:
    """Blocks that are kept: block ``i`` starts at the ``i``-th block tag, the first before any."""
    starts = F.concat(F.array(F.lit(0)), places)
    ends = F.concat(places, F.array(F.size(toks) + 1))
    blocks = F.transform(
        F.arrays_zip(starts.alias("start"), ends.alias("end")),
        lambda b: F.struct(
            F.when(b["start"] > 0, F.element_at(toks, F.greatest(b["start"], F.lit(1)))).otherwise("").alias("tag"),
            F.slice(toks, b["start"] + 1, b["end"] - b["start"] - 1).alias("inner"),
        ),
    )

    def measured(b: Column) -> Column:
        is_code = b["tag"].rlike(r"(?i)^<pre(?=[\s/>])")
        spaced = F.transform(b["inner"], lambda t: F.when(t.rlike(r"(?i)^<br(?=[\s/>])"), " ").otherwise(t))
        text = words_of(spaced)
        code = squash(_markless(inside(b["tag"])))
        linked = F.aggregate(_anchors(b["inner"]), F.lit(0), lambda n, a: n + F.length(a["text"]) + F.when(n > 0, 1).otherwise(0))
        marks = F.aggregate(F.filter(b["inner"], _is_tag), F.lit(0), lambda n, t: n + F.length(t))
        return F.struct(
            F.when(is_code, squash(F.concat_ws(" ", code, text))).otherwise(text).alias("text"),
            linked.alias("linked"),
            (marks + F.when(is_code, 11).otherwise(F.length(b["tag"]))).alias("markup"),
            F.coalesce(F.element_at(_tag_weights(), F.regexp_replace(tag_name(b["tag"]), "/", "")), F.lit(OTHER_TAG)).alias("weight"),
        )

    def kept(scored: Column) -> Column:
        chars = F.aggregate(scored, F.lit(0), lambda n, b: n + F.length(b["text"]))
        markup = F.aggregate(scored, F.lit(0), lambda n, b: n + b["markup"])
        threshold = THRESHOLD * (0.5 + chars / F.greatest(chars + markup, F.lit(1)))
        return let(threshold, lambda least: F.filter(scored, lambda b: _good(b, least)))

    return let(F.transform(blocks, measured), lambda s: F.array_join(F.transform(kept(s), lambda b: b["text"]), "\n\n"))


def _good(block: Column, threshold: Column) -> Column:
    chars = F.length(block["text"])
    score = (
        TEXT_WEIGHT * chars / F.greatest(chars + block["markup"], F.lit(1))
        + PLAIN_WEIGHT * (1 - block["linked"] / F.greatest(chars, F.lit(1)))
        + TAG_WEIGHT * block["weight"]
    )
    enough = F.size(F.split(block["text"], " ")) >= MIN_WORDS
    return enough & (block["linked"] <= chars * MAX_LINK_SHARE) & (score >= threshold)


def _tag_weights() -> Column:
    return F.from_json(F.lit(json.dumps(TAGS)), "map<string,double>")


# --- parts -----------------------------------------------------------------------------


def page_title(html: Column) -> Column:
    """Text of the first title element outside of drawings and templates; NULL if there is none."""
    # No title ends behind the last end tag of one, so the rest need not be split.
    head = F.regexp_extract(html, r"(?is)^(.*</title(?=[\s/>]))", 1)
    titles = let(
        tokens(F.concat(head, F.lit(">"))),
        lambda t: F.filter(without(t, ("template", "svg")), lambda t: t.rlike(r"(?i)^<title(?=[\s/>])")),
    )
    return let(let(inside(F.get(titles, F.lit(0))), lambda t: squash(unescape(t))), lambda t: F.nullif(t, F.lit("")))


def page_meta(html: Column) -> Column:
    """``STRUCT<title, language, canonical, meta>`` of a page; parts that it lacks are NULL.

    ``meta`` maps the lower-case ``name``, ``property`` or ``http-equiv`` of meta tags to
    their content. Of several with one name the first counts; those without name
    or content, and any inside of drawings and templates, are left out.
    """

    def first(toks: Column, pattern: str) -> Column:
        return F.get(F.filter(toks, lambda t: t.rlike(pattern)), F.lit(0))

    def parts(toks: Column) -> Column:
        pairs = F.filter(
            F.transform(
                F.filter(toks, lambda t: t.rlike(r"(?i)^<meta(?=[\s/>])")),
                lambda t: F.struct(
                    F.lower(strip(F.coalesce(attribute(t, "name"), attribute(t, "property"), attribute(t, "http-equiv")))).alias("key"),
                    attribute(t, "content").alias("value"),
                ),
            ),
            lambda p: (p["key"] != "") & p["value"].isNotNull(),
        )
        links = F.filter(toks, lambda t: t.rlike(r"(?i)^<link(?=[\s/>])"))
        canonical = F.filter(links, lambda t: F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), "canonical"))
        full = lambda x: let(x, lambda v: F.nullif(strip(v), F.lit("")))
        named = let(pairs, lambda p: F.map_from_entries(F.filter(p, lambda x, i: ~F.exists(F.slice(p, 1, i), lambda y: y["key"] == x["key"]))))
        return F.struct(
            page_title(html).alias("title"),
            full(attribute(first(toks, r"(?i)^<html(?=[\s/>])"), "lang")).alias("language"),
            full(attribute(F.get(canonical, F.lit(0)), "href")).alias("canonical"),
            named.alias("meta"),
        )

    found = let(tokens(html), lambda t: let(without(t, ("template", "svg")), parts))
    return F.when(html.isNotNull(), found)


def anchors(html: Column) -> Column:
    """``ARRAY<STRUCT<href, text>>`` of the anchors of a page in order."""
    return shown(html, _anchors)


def _anchors(toks: Column) -> Column:
    """An anchor ends at its end tag, at the next anchor, or with the page."""
    marks = F.filter(
        F.transform(toks, lambda t, i: F.when(t.rlike(r"(?i)^</?a(?=[\s/>])") & F.endswith(t, F.lit(">")), i + 1).otherwise(0)), lambda i: i > 0
    )

    def found(places: Column) -> Column:
        each = F.transform(
            places,
            lambda at, i: F.struct(
                attribute(F.element_at(toks, at), "href").alias("href"),
                words_of(
                    F.slice(toks, at + 1, F.coalesce(F.get(places, i + 1), F.size(toks) + 1) - at - 1)
                ).alias("text"),
                F.startswith(F.element_at(toks, at), F.lit("</")).alias("closes"),
            ),
        )
        links = F.filter(each, lambda a: a["href"].isNotNull() & ~a["closes"])
        return F.transform(links, lambda a: F.struct(a["href"].alias("href"), a["text"].alias("text")))

    return let(marks, found)
