"""Main text of web pages by template deduction over the pages of a host.

Pages are cut into tokens: tags with the path of elements they stand in, and runs of text. A token's
occurrence vector says how often it is on each page of its host. Tokens with the same vector form an
equivalence class; classes on enough pages are valid, however small their share of the host is, so that each of a
host's page layouts has its own. They nest by the elements that their tokens stand in: this is the host's template.
What lies between template tokens are slots. Text that is itself a template token is
boilerplate, on pages with marked main elements too; the slots whose container holds most text over the host's
pages are the page's main text, or those in elements that HTML marks as main, all of an outer one, unless the host's
main slot lies elsewhere and holds more. Parts whose element or class says that they serve another end stay out.

Vectors are never collected: a token is reduced to the number of its pages, its count and the exclusive or
of hashes of (page, count), summed within each task first. A host's template holds the tokens of all its layouts.

Defined results: a null or empty html gives an empty text; pages with a null url, or one without a host, form
one host of their own; a page alone on its host has no template and is judged by its elements; repeated
rows are pages of their own; an empty table gives no rows. Columns other than the three named are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import pick, stored

#: A template token is on so many pages of its host at least.
PAGES = 4

#: Comment or declaration; raw element with all that it holds; tag; text.
PARTS = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|object|svg|select|canvas|video|audio)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)

#: Fixed values of HTML: elements that never hold others, that end a block, and that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose content serves another end than the article.
ASIDE = frozenset("head title nav header footer aside form menu dialog button fieldset input label datalist map".split())
MAIN = ("article", "main")
#: Elements that hold a line or paragraph of text: a word of their class says how it looks more often than what it serves.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption span b i em strong a".split())
#: Words in class, id or role that say the same; and those that mark the main part.
OTHER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion nav navbar navigation menu menubar submenu "
    "breadcrumb breadcrumbs crumbs header masthead topbar footer bottombar colophon copyright sidebar aside rail widget widgets related recommended recommendations "
    "more share sharing social follow comment comments commentlist reply replies respond discussion disqus cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login signin search searchbox form pagination pager paging skip toolbar tags tagcloud toc contentinfo complementary".split()
)
CONTENT = frozenset("article content main post entry story body text".split())
NAME = re.compile(r"[a-zA-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def _element(name: str, attributes: str, inside: bool) -> tuple[str, bool, bool]:
    """Label for paths, whether the element serves another end, whether it is marked as the main part.

    A line serves another end only if all words of its class or id say so ("related-work" is a heading), and the header
    of an element that is marked as main is the article's own.
    """
    own_header = name == "header" and inside
    other, main, label = name in ASIDE and not own_header, name in MAIN, name
    if attributes and ("=" in attributes or "hidden" in attributes):
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
            if key in ("class", "id", "role", "itemprop"):
                words = {w.lower() for w in NAME.findall(value)}
                if key == "class":
                    label = f"{name}.{value.strip()}" if value.strip() else name
                if value.lower() == "articlebody" or (key == "role" and value == "main"):
                    main = True
                elif name in LINES:
                    other = other or bool(words) and words <= OTHER
                elif name not in ("html", "body", *MAIN) and words & OTHER and not (own_header and words & OTHER <= {"header"}):
                    # "main-header" is a header, "post-content" is content
                    other = True
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and HIDDEN.search(value)):
                other = True
    return label, other, main


def blocks(html: str) -> Iterator[tuple[str, str, bool, int]]:
    """The page's tokens in order: (path of elements, text or "" for a tag, serves another end, number of the
    outermost element marked as main or 0). Texts of inline elements join their block."""
    stack: list[tuple[str, str, str, bool, int]] = []  # element, label, path, other, main
    path, other, main, mains = "", False, 0, 0
    text: list[str] = []
    for m in PARTS.finditer(html):
        kind = m.lastgroup
        if kind == "text":
            text.append(m["text"])
            continue
        name = m["name"]
        if name is None:
            if m["raw"]:
                text.append(" ")
            continue
        name = name.lower()
        if name in INLINE and not (m["attributes"] and "class" in m["attributes"] or "hidden" in m["attributes"]):
            continue
        if name == "br" or name in INLINE and m["end"]:
            # an inline element that was opened as a block of its own is closed below
            if name == "br" or not any(e[0] == name for e in stack):
                text.append(" " if name == "br" else "")
                continue
        inside = bool(stack) and stack[-1][4] > 0
        label, is_other, is_main = (name, False, False) if m["end"] else _element(name, m["attributes"], inside)
        if name in INLINE and not m["end"] and not is_other:
            continue
        if text:
            joined = " ".join(unescape("".join(text)).split())
            text.clear()
            if joined:
                yield path, joined, other, main
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        else:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or name in ("h1", "h2", "h3", "h4", "h5", "h6", "div", "ul", "ol", "table", "section"):
                # these end an open paragraph; an item ends an open item of its own list
                if stack and (stack[-1][0] == "p" or stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    stack.pop()
            if name == "body":
                # a head that was never closed ends here
                stack[:] = [e for e in stack if e[0] == "html"]
            above = stack[-1] if stack else ("", "", "", False, 0)
            if name not in VOID:
                if is_main and not above[4]:
                    mains += 1
                stack.append((name, label, f"{above[2]}/{label}", above[3] or is_other, above[4] or (mains if is_main else 0)))
                yield stack[-1][2], "", stack[-1][3], stack[-1][4]
        path, other, main = stack[-1][2:] if stack else ("", False, 0)
    if text:
        joined = " ".join(unescape("".join(text)).split())
        if joined:
            yield path, joined, other, main


def container(path: str) -> str:
    """The path without the paragraph, heading or item at its end."""
    parts = path.split("/")
    while len(parts) > 2 and parts[-1].split(".")[0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre", "table", "tbody", "tr", "td", "th", "dl", "dt", "dd", "figure", "figcaption", "span", "b", "a"):
        parts.pop()
    return "/".join(parts)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def host_of(pages: DataFrame):
    return F.coalesce(F.lower(F.regexp_extract(pick(pages, "url")[0], r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, path, text, pages, total, vector, chars) of every token; chars are counted for containers only.

    text says whether the token is a run of text; its path is where it stands.
    """
    id_, html = pick(pages, "page_id", "html")
    schema = "host string, token long, path string, text boolean, pages long, total long, vector long, chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list] = {}

        def flush() -> pa.RecordBatch:
            rows = [(h, t, *v) for (h, t), v in sums.items()]
            sums.clear()
            kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows)) or [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "token", "path", "text", "pages", "total", "vector", "chars"])

        for batch in batches:
            for page, host, html in zip(*(c.to_pylist() for c in batch.columns)):
                seen: Counter = Counter()
                mass: Counter = Counter()
                for path, text, other, _ in blocks(html or ""):
                    seen[path, text] += 1
                    if text and not other:
                        mass[container(path)] += len(text)
                seen["", ""] += 1  # stands for the page
                for (path, text), n in seen.items():
                    token = _hash(f"{path}\n{text}")
                    s = sums.get((host, token))
                    vector = xxhash.xxh3_64_intdigest(f"{page}:{n}") - 2**63
                    if s is None:
                        sums[host, token] = [path, bool(text), 1, n, vector, 0]
                    else:
                        s[2] += 1
                        s[3] += n
                        s[4] ^= vector
                for path, chars in mass.items():
                    token = _hash(f"{path}\ncontainer\n")
                    s = sums.setdefault((host, token), [path, False, 0, 0, 0, 0])
                    s[5] += chars
                if len(sums) > 50_000:
                    yield flush()
        if sums:
            yield flush()

    parts = pages.select(id_.cast("string").alias("page"), host_of(pages).alias("host"), html.cast("string").alias("html")).mapInArrow(run, schema)
    return parts.groupBy("host", "token").agg(
        F.min("path").alias("path"), F.max("text").alias("text"), F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.bit_xor("vector").alias("vector"), F.sum("chars").alias("chars")
    )


def host_templates(tokens: DataFrame, least: int = PAGES) -> DataFrame:
    """Per host: n_pages, classes (pages, total, paths and text tokens of each valid class, outer ones first),
    main (container with most text). Built from occurrences().

    A class is valid on enough pages, if it has two tokens or more, or a text where texts hardly vary. The texts of
    an element vary if a quarter of them or more are on fewer pages than a class needs: these are slots. Repeated
    text there is the template's if it is on half the element's pages; else it is what some pages' articles share.
    """
    sizes = tokens.where((F.col("path") == "") & ~F.col("text") & (F.col("pages") > 0)).select("host", F.col("pages").alias("n_pages"))
    heaviest = tokens.where("chars > 0").groupBy("host").agg(F.max_by("path", F.struct("chars", "path")).alias("main"))
    seen = tokens.where((F.col("path") != "") & (F.col("pages") > 0))
    rare = F.when(F.col("text") & (F.col("pages") < least), F.col("total")).otherwise(0)
    elements = seen.groupBy("host", "path").agg(
        (F.sum(rare) * 4 >= F.sum(F.when(F.col("text"), F.col("total")).otherwise(0))).alias("slot"), F.max(F.when(~F.col("text"), F.col("pages"))).alias("around"), F.max("pages").alias("most")
    )
    # the elements of repeated tokens only
    common = seen.where(F.col("pages") >= least).join(elements.where(F.col("most") >= least), ["host", "path"])
    member = F.struct(F.length("path").alias("depth"), "path", F.when(F.col("text"), F.col("token")).alias("token"), "slot", (F.col("pages") * 2 >= F.coalesce("around", "pages")).alias("usual"))
    classes = common.groupBy("host", "pages", "total", "vector").agg(F.array_sort(F.collect_list(member)).alias("tokens"))
    several = F.size("tokens") >= 2
    kept = F.filter("tokens", lambda t: t["token"].isNull() | ~t["slot"] | several & t["usual"])
    valid = classes.withColumn("tokens", kept).where(F.exists("tokens", lambda t: t["token"].isNotNull()) | (F.size("tokens") >= 2))
    entry = F.struct(F.col("tokens")[0]["depth"].alias("depth"), F.col("tokens")[0]["path"].alias("top"), "pages", "total", "tokens")
    nested = valid.groupBy("host").agg(F.array_sort(F.collect_list(entry)).alias("classes"))
    return sizes.join(nested, "host", "left").join(heaviest, "host", "left")


def main_text(html: str, boilerplate: set[int], main: str | None) -> str:
    """The text of the page's main slots; boilerplate: text tokens of the host's template."""
    texts = [(path, text, inside) for path, text, other, inside in blocks(html) if text and not other]
    slots = [(path, text, inside) for path, text, inside in texts if _hash(f"{path}\n{text}") not in boilerplate]
    # a page that the template would leave nothing of is a copy of others, not an instance of the template
    slots = slots or texts
    size = lambda part: sum(len(text) for _, text, _ in part)
    whole, marked = [x for x in texts if x[2]], [x for x in slots if x[2]]
    if 2 * size(marked) < size(whole):
        # so is one that would lose most of its marked text
        marked = whole
    under = [x for x in slots if main and f"{container(x[0])}/".startswith(f"{main}/")]
    if marked:
        # marked elements are a hint: the host's main slot outweighs them if it lies elsewhere and holds more
        slots = under if not any(x[2] for x in under) and size(under) > size(marked) else marked
    elif under and size(under) * 2 >= size(slots):
        slots = under
    return " ".join(text for _, text, _ in slots)


def extracted(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    templates = host_templates(stored(occurrences(pages), "tokens"))
    constant = F.flatten(F.transform("classes", lambda c: F.filter(F.transform(c["tokens"], lambda t: t["token"]), lambda t: t.isNotNull())))
    # a table of its own, so that Spark sees its size and can split a hot host's pages in the join
    known = stored(templates.select("host", F.coalesce(constant, F.array().cast("array<long>")).alias("boilerplate"), "main"), "templates")
    id_, url, html = pick(pages, "page_id", "url", "html")
    rows = pages.select(id_.cast("long").alias("page_id"), url.cast("string").alias("url"), html.cast("string").alias("html"), host_of(pages).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in (2, 3, 4))
            texts = [main_text(html, set(boilerplate or ()), main) if html else "" for html, boilerplate, main in zip(*columns)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    joined = rows.join(known, "host", "left").select("page_id", "url", "html", "boilerplate", "main")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
