"""Main text of web pages: page structure, and runs of tokens that a host's pages repeat.

A page becomes blocks of text in page order.  Each has a place: in boilerplate
elements (menus, footers, adverts, forms, comments and so on, by tag, role or
class), in the main element (article or main), or elsewhere.

The token streams of what is not in boilerplate elements, for all pages of a host,
are laid end to end in a suffix array, whose
suffixes are sorted by prefix doubling up to their first RUN tokens: neighbours
that agree so far are an interval, and what lies below an interval is a substring
of RUN tokens.  A longer substring that repeats is where such ones overlap, so no
greater depth is needed to know which tokens repeated substrings cover.  Those
that PAGES different streams hold are repeated; pages with equal streams count as
one, so copies of a page are not each other's boilerplate.  Where a page has a
main element, that is its main text, less the tokens of substrings that half the
host's streams hold: pages share passages of their articles, but never so many of
a host do.  Where it has none, its blocks elsewhere are, less the tokens that
repeated substrings cover; unique runs stay.

Pages travel to their host packed, many to a message, those of small hosts
together.  A host with many pages is dealt out in shards, and its substrings of
RUN tokens, as hashes, in as many buckets.  Each bucket counts its substrings'
streams over the whole host and tells the shards which of theirs are repeated, so
shards change no result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import grams, mix
from .urls import host_and_path

#: Tokens of a run, different streams that hold it, pages of a shard, and the share of pages above which a host's shards are sent to all tasks.
RUN, PAGES, SHARD, HOT_SHARE = 8, 3, 2000, 100_000
#: In main elements, a run goes if one in so many of the host's streams holds it.
MAIN_SHARE = 2
_TAG = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?][^>]*(?:>|$)|</?[a-zA-Z][^>]*$""", re.S)
#: One attribute after another, so that nothing within a name or a value is taken for an attribute.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOLD = re.compile("class|id|role|hidden", re.I)
_RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_SKIP = {"head", "nav", "footer", "aside", "form", "button", "select", "script", "style", "noscript", "template", "svg", "iframe", "dialog", "menu", "textarea", "title", "object", "canvas", "math", "noembed", "noframes", "xmp"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "head", "option", "select", "button", "title", "script", "style",
}
_ENDS_P = _BLOCK - {"br", "script", "style", "title"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "pager", "paywall", "popup", "promo", "promoted", "recommended", "related", "responses", "share", "sharing",
    "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
#: Words in a name that say how a page is laid out, or what state it is in, not what an element holds.
_LAYOUT = {"has", "with", "without", "no", "is", "not", "open", "opened", "closed", "active", "enabled", "disabled", "show", "hide", "fixed", "sticky", "left", "right", "layout", "page", "body", "content", "main", "site", "wrap", "wrapper", "container", "inner", "outer"}
OUT, ELSEWHERE, MAIN = 0, 1, 2
#: Boilerplate by its name, in which a main element still counts; by a part of a name, or a form, in which an article does too.
NAMED, LOOSE, FORM = -1, -2, -3


def _attributes(attributes: str) -> dict[str, str]:
    """The attributes of a tag; of two of one name the first counts."""
    if not _TOLD.search(attributes):
        return {}
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _kind(tag: str, known: dict[str, str], in_main: bool) -> int:
    """OUT, NAMED, LOOSE or FORM for boilerplate, else ELSEWHERE; known: the tag's attributes."""
    if tag == "form":
        return FORM
    if tag in _SKIP or (tag == "header" and not in_main):
        return OUT
    if tag in ("body", "html") or not known:
        return ELSEWHERE
    whole = {*(known.get("class", "") + " " + known.get("id", "")).lower().split()}
    parts = {x for name in whole for x in re.split(r"[^a-z0-9]+", name)}
    if tag in ("article", "main"):  # a comment or an advert may be an article
        return OUT if {"comment", "comments", "response", "responses"} & parts or (tag == "article" and whole & _NAMES) else ELSEWHERE
    if "hidden" in known or known.get("aria-hidden", "").lower() == "true" or known.get("role", "").lower() in _ROLES:
        return OUT
    if tag in _HEADINGS:  # named after what they head
        return ELSEWHERE
    if whole & _NAMES or (not in_main and "header" in whole):
        return NAMED
    if any(words & _NAMES and not words & _LAYOUT for words in ({*re.split(r"[^a-z0-9]+", name)} for name in whole)):
        return LOOSE
    return ELSEWHERE


def blocks(page: str | None) -> tuple[list[str], list[int]]:
    """The blocks of a page that are not boilerplate, and their places; white space in a block is one space.

    Forms, and then what is loosely boilerplate, are not, where they hold more text than the rest of the page that may be main.
    """
    if not page:
        return [], []
    texts: list[str] = []
    places: list[int] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and what holds inside them
    place = ELSEWHERE

    def close() -> None:
        if held:
            if text := " ".join("".join(held).split()):
                texts.append(text)
                places.append(place)
            held.clear()

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        chunk = page[at : m.start()] if m else page[at:]
        if chunk:
            held.append(html.unescape(chunk) if "&" in chunk else chunk)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in _BLOCK:
            close()
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            if depth >= 0:
                if any(inner != stack[depth - 1][1] if depth else inner != ELSEWHERE for _, inner in stack[depth:]):
                    close()
                del stack[depth:]
                place = stack[-1][1] if stack else ELSEWHERE
            continue
        if tag in _VOID:
            continue
        if tag in _ENDS_P:  # a paragraph ends where the next block begins
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or stack[k][0] in ("div", "article", "section", "body", "td", "li", "blockquote")), -1)
            if depth >= 0 and stack[depth][0] == "p":
                del stack[depth:]
                place = stack[-1][1] if stack else ELSEWHERE
        inner = place
        if place != OUT:
            known = _attributes(m[3])
            kind = _kind(tag, known, place == MAIN)
            is_main = tag == "main" or known.get("role", "").lower() == "main"
            if is_main and kind != OUT or tag == "article" and kind == ELSEWHERE and place != NAMED:
                inner = MAIN
            elif kind != ELSEWHERE:
                inner = kind if place > 0 else max(place, kind)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if inner != place:
            close()
        if not m[3].endswith("/") or tag in _BLOCK:
            stack.append((tag, inner))
            place = inner
    close()
    for kind in (FORM, LOOSE):
        if kind in places and sum(len(t) * ((p == kind) - (p > 0)) for t, p in zip(texts, places, strict=True)) > 0:
            places = [ELSEWHERE if p == kind else p for p in places]
    kept = [(t, p) for t, p in zip(texts, places, strict=True) if p > OUT]
    return [t for t, _ in kept], [p for _, p in kept]


def suffix_array(token: np.ndarray, page_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that have RUN tokens before their page's end, sorted by these, and where intervals of equal ones begin."""
    rank = np.unique(token, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < RUN:
        step = min(width, RUN - width)
        follow = np.full(len(rank), -1, np.int64)
        follow[: len(rank) - step] = rank[step:]
        pair = rank * (len(rank) + 1) + follow + 1
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        width += step
    whole = np.flatnonzero(np.arange(len(token)) + RUN <= page_end)
    order = whole[np.argsort(rank[whole], kind="stable")]
    new = np.ones(len(order), bool)
    new[1:] = rank[order[1:]] != rank[order[:-1]]
    return order, np.flatnonzero(new)


_U = np.uint64


def _stream(texts: list[str], places: list[int]) -> int:
    """A hash of a page's blocks and their places; never negative."""
    return xxhash.xxh64_intdigest("\n".join(texts).encode("utf-8", "replace") + b"\n" + bytes(places)) >> 1


def _hashes(token: list[int]) -> np.ndarray:
    """A hash of 48 bits of each run, by its first token."""
    return mix(grams(np.array(token, _U), RUN)) >> _U(16)


def _token(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))


def _packed(sorted_values: np.ndarray) -> bytes:
    """Steps between values, byte by byte of their places: what is zero compresses."""
    steps = np.diff(sorted_values.astype(_U), prepend=_U(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view(_U).ravel(), dtype=_U)


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _covered(held: np.ndarray, least: int) -> np.ndarray:
    """Which tokens are in a run that so many streams hold."""
    often = np.flatnonzero(held >= least)
    edge = np.zeros(len(held) + 1, np.int64)
    np.add.at(edge, often, 1)
    np.add.at(edge, np.minimum(often + RUN, len(held)), -1)
    return np.cumsum(edge)[:-1] > 0


def repeated(pages: list[tuple[list[str], list[int]]], known: tuple[int, np.ndarray, np.ndarray] | None = None) -> list[list[np.ndarray]]:
    """Of each block of each page, which tokens go.

    known: of the host that these are some pages of, the number of streams, and
    hashes of repeated runs, sorted, with the number of streams that hold each.
    """
    streams: dict[tuple, int] = {}
    first = [streams.setdefault((tuple(t), tuple(p)), len(streams)) for t, p in pages]
    distinct = list(streams)
    words = [[b.split() for b in t] for t, _ in distinct]
    size = np.array([sum(map(len, w)) for w in words], np.int64)
    number: dict[str, int] = {}
    token = np.array([number.setdefault(x, len(number)) for w in words for b in w for x in b], np.int64)
    place = np.repeat(np.array([p for _, ps in distinct for p in ps], np.int64), [len(b) for w in words for b in w]) if len(token) else np.empty(0, np.int64)
    gone = np.zeros(len(token), bool)
    if len(token) >= RUN:
        of = np.repeat(np.arange(len(distinct)), size)
        held = np.zeros(len(token), np.int64)
        if known is None:
            n_streams = len(distinct)
            order, begins = suffix_array(token, np.cumsum(size)[of])
            # an interval is in the order of places, so a page's suffixes stand together in it
            fresh = np.ones(len(order), np.int64)
            fresh[1:] = of[order[1:]] != of[order[:-1]]
            fresh[begins] = 1
            if len(begins):
                held[order] = np.repeat(np.add.reduceat(fresh, begins), np.diff(np.append(begins, len(order))))
        elif len(known[1]):
            n_streams, runs, counts = known
            whole = np.flatnonzero(np.arange(len(token)) + RUN <= np.cumsum(size)[of])
            h = _hashes(np.array([_token(x) for x in number], _U)[token])[whole]
            at = np.minimum(np.searchsorted(runs, h), len(runs) - 1)
            held[whole] = np.where(runs[at] == h, counts[at], 0)
        else:
            n_streams = known[0]
        gone = (_covered(held, PAGES) & (place == ELSEWHERE)) | (_covered(held, max(PAGES, -(-n_streams // MAIN_SHARE))) & (place == MAIN))
    cut = np.cumsum([len(b) for w in words for b in w])[:-1] if len(token) else []
    parts = np.split(gone, cut) if len(token) else []
    starts = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    return [parts[starts[k] : starts[k + 1]] for k in first]


def main_texts(pages: list[tuple[list[str], list[int]]], known: tuple[int, np.ndarray, np.ndarray] | None = None) -> list[str]:
    """The main text of each of one host's pages, given their blocks and places."""
    out = []
    for (texts, places), gone in zip(pages, repeated(pages, known), strict=True):
        wanted = MAIN if MAIN in places else ELSEWHERE
        kept = []
        for text, place, g in zip(texts, places, gone, strict=True):
            if place == wanted:
                kept.extend([text] if not g.any() else [x for x, k in zip(text.split(), g, strict=True) if not k])
        out.append(" ".join(kept))
    return out


_RUNS = "host string, shards int, bucket long, streams binary, runs binary, holder binary, own binary"


def _runs_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of large hosts' streams, by bucket: hashes, sorted, and which of the streams holds each; the streams that a bucket counts."""
    for batch in batches:
        hosts: dict[tuple[str, int], dict[int, np.ndarray]] = {}
        tokens: dict[str, int] = {}
        for host, shards, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            texts, places = blocks(page)
            held = hosts.setdefault((host, shards), {})
            if (stream := _stream(texts, places)) not in held:
                words = [x for t in texts for x in t.split()]
                for x in words:
                    if x not in tokens:
                        tokens[x] = _token(x)
                held[stream] = np.unique(_hashes([tokens[x] for x in words]))
        for (host, shards), held in hosts.items():
            streams = np.array(list(held), np.int64)
            runs = np.concatenate(list(held.values()))
            holder = np.repeat(np.arange(len(streams)), [len(r) for r in held.values()])
            bucket = (runs % _U(shards)).astype(np.int64)
            order = np.lexsort((runs, bucket))
            edge = np.searchsorted(bucket[order], np.arange(shards + 1))
            for k in range(shards):
                part = order[edge[k] : edge[k + 1]]
                own = streams[streams % shards == k]
                if len(part) or len(own):
                    yield pa.RecordBatch.from_pydict({"host": [host], "shards": pa.array([shards], pa.int32()), "bucket": [k], "streams": [streams.tobytes()], "runs": [_packed(runs[part])], "holder": [_planes(holder[part])], "own": [own.tobytes()]})


_FOUND = "host string, shard long, n_streams long, runs binary, counts binary"


def _counted(table: pa.Table) -> pa.Table:
    """One bucket's runs that PAGES streams of the host hold, for each shard that has such a stream; to each shard, how many streams this bucket counts."""
    host, shards = table.column("host")[0].as_py(), table.column("shards")[0].as_py()
    rows = table.select(["streams", "runs", "holder", "own"]).to_pylist()
    own = len(np.unique(np.concatenate([np.frombuffer(r["own"], np.int64) for r in rows])))
    run = np.concatenate([_unpacked(r["runs"]) for r in rows])
    stream = np.concatenate([np.frombuffer(r["streams"], np.int64)[_from_planes(r["holder"])] for r in rows])
    order = np.lexsort((stream, run))
    run, stream = run[order], stream[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (stream[1:] != stream[:-1])
    run, stream = run[new], stream[new]
    _, at, counts = np.unique(run, return_inverse=True, return_counts=True)
    often = counts[at] >= PAGES
    run, shard, n = run[often], stream[often] % shards, counts[at][often]
    out = []
    for k in range(shards):
        mine, first = np.unique(run[shard == k], return_index=True)
        out.append({"host": host, "shard": k, "n_streams": own, "runs": _packed(mine), "counts": _planes(n[shard == k][first])})
    return pa.Table.from_pylist(out, pa.schema([("host", pa.string()), ("shard", pa.int64()), ("n_streams", pa.int64()), ("runs", pa.binary()), ("counts", pa.binary())]))


#: Characters of pages that a task collects before it sends them.
SEND_CHARS = 16 << 20


def _message(rows: list[tuple], kind: pa.DataType) -> bytes:
    """Parsed pages as a compressed stream of Arrow's."""
    names = ["host", "page_id", "url", "texts", "places"]
    kinds = [pa.string(), kind, pa.string(), pa.list_(pa.string()), pa.list_(pa.int8())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages, from whole pages.

    A null or empty page has the empty text.  Pages without a host, null URLs
    among them, are one host.  Repeated rows are pages of their own with equal
    streams.  A page cut off within a tag loses that tag.  A page that has a main
    element has its text alone, others what is not boilerplate.  Without pages:
    no rows.  Other columns are not looked at.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), F.col(html_col).cast("string").alias("html"), F.coalesce(host_and_path(url)[0], F.lit("")).alias("host"))
    counts = rows.groupBy("host").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    large = counts.where(F.col("n") > SHARD).select("host", "n", F.expr(f"cast(n div {SHARD} + 1 AS int)").alias("shards"))
    bound = total // HOT_SHARE
    # the largest, fewer than HOT_SHARE, are sent to all tasks; those between, if there can be any, are joined
    dealt = rows.join(F.broadcast(large.where(F.col("n") > bound).drop("n")), "host", "left")
    if bound > SHARD:
        between = large.where(F.col("n") <= bound).select("host", F.col("shards").alias("more"))
        dealt = dealt.join(between, "host", "left").withColumn("shards", F.coalesce("shards", "more")).drop("more")
    # a group: some small hosts, or a shard of a large one
    groups = total // SHARD + 1
    dealt = dealt.withColumn("bucket", F.concat(F.lit("+"), F.pmod(F.xxhash64("host"), F.lit(groups)).cast("string")))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        size, kind = 0, pa.null()
        for batch in batches:
            kind = batch.schema.field(0).type
            for page_id, url, host, shards, bucket, page in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                texts, places = blocks(page)
                # equal streams are in one shard
                group = f"={_stream(texts, places) % shards} {host}" if shards else bucket
                held.setdefault(group, []).append((host, page_id, url, texts, places))
                size += len(page or "") + 100
                if size > SEND_CHARS:
                    for g, own in held.items():
                        yield pa.RecordBatch.from_pydict({"group": [g], "pages": [_message(own, kind)]})
                    held, size = {}, 0
        for g, own in held.items():
            yield pa.RecordBatch.from_pydict({"group": [g], "pages": [_message(own, kind)]})

    kind = dict(rows.dtypes)["page_id"]
    parsed = dealt.select("page_id", "url", "host", "shards", "bucket", "html").mapInArrow(parse, "group string, pages binary")

    def clean(table: pa.Table, found: pa.Table) -> pa.Table:
        known = None
        if found.num_rows:
            runs = np.concatenate([_unpacked(x) for x in found.column("runs").to_pylist()])
            counts = np.concatenate([_from_planes(x) for x in found.column("counts").to_pylist()]).astype(np.int64)
            order = np.argsort(runs)
            known = sum(found.column("n_streams").to_pylist()), runs[order], counts[order]
        own = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in table.column("pages").to_pylist()])
        own = own.sort_by("host")
        hosts = own.column("host").to_pylist()
        pairs = list(zip(own.column("texts").to_pylist(), own.column("places").to_pylist(), strict=True))
        texts: list[str] = []
        while len(texts) < len(hosts):
            at = len(texts)
            to = at + 1
            while to < len(hosts) and hosts[to] == hosts[at]:
                to += 1
            texts += main_texts(pairs[at:to], known)
        return pa.table({"page_id": own.column("page_id"), "url": own.column("url"), "text": pa.array(texts, pa.string())})

    found = dealt.where("shards IS NOT NULL").select("host", "shards", "html").mapInArrow(_runs_of, _RUNS).groupBy("host", "bucket").applyInArrow(_counted, _FOUND)
    told = found.select(F.concat(F.lit("="), F.col("shard").cast("string"), F.lit(" "), F.col("host")).alias("group"), "n_streams", "runs", "counts")
    cleaned = parsed.groupBy("group").cogroup(told.groupBy("group")).applyInArrow(clean, f"page_id {kind}, url string, text string")
    return cleaned.withColumn("n_chars", F.length("text").cast("long"))
