"""URL filters: host and path rules, then a weighted vocabulary.

Rules decide where one fits; the longest wins.  Elsewhere the vocabulary does:
one Aho-Corasick pass over the URL, its escapes decoded, finds every strict and
soft term, of which those count that stand alone, between other characters than
a-z and 0-9.  One strict term rejects the URL, or SOFT_LIMIT different soft ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms that reject by themselves.
STRICT = [
    "porn", "porno", "porns", "pornos", "pornhub", "pornstar", "pornstars", "pornography", "xxx", "xxxvideo", "xxxvideos", "hentai", "milf", "milfs", "camgirl", "camgirls", "sexcam", "sexcams",
    "sexchat", "sexshop", "sextube", "sexvideo", "sexvideos", "nsfw", "adult-x", "x-rated", "adult-video", "adult-videos", "adult-movies", "adult-toys", "adults-only", "gangbang", "blowjob", "blowjobs", "creampie", "cumshot", "cumshots", "bdsm", "upskirt", "escortgirls", "escortservice",
    "whores", "sluts", "pussy", "fuck", "fucking", "fucked", "shemale", "shemales", "warez", "keygen", "keygens", "crackz", "serialz", "phishing", "malware", "spyware", "adware", "ransomware", "spamfarm", "linkfarm",
]
#: Terms of which SOFT_LIMIT different ones reject.
SOFT = [
    "adult", "adults", "xrated", "18plus", "sex", "sexy", "sexual", "nude", "nudes", "naked", "erotic", "erotica", "erotik", "fetish", "kinky", "lingerie", "hot", "girls", "babes", "teens", "amateur", "escort", "escorts", "cam", "cams", "webcam", "webcams", "dating", "hookup", "hookups", "singles",
    "casino", "casinos", "bet", "bets", "betting", "bookmaker", "gambling", "poker", "roulette", "blackjack", "bingo", "slots", "slot", "jackpot", "lottery", "win", "winner", "prize", "prizes", "bonus", "free", "cheap", "discount", "deal", "deals", "coupon", "coupons", "viagra", "cialis", "levitra", "xanax", "tramadol",
    "pill", "pills", "pharmacy", "pharma", "meds", "drugs", "steroids", "replica", "replicas", "fake", "loan", "loans", "payday", "credit", "crypto", "forex", "torrent", "torrents", "crack", "cracked", "cracks", "serial", "nulled", "download", "spam", "farm", "backlinks", "ads", "adserver", "banner", "banners", "track", "tracker", "tracking", "click", "clicks", "popup", "popups", "affiliate", "redirect",
]
SOFT_LIMIT = 2
#: (verdict, host, path); a rule fits its host and all subdomains, and paths that start with its own.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty if the URL is null or has no "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host, path = (F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", k) for k in (1, 2))
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def decoded(url: str) -> str:
    """The URL without escapes; as it is if they are not UTF-8."""
    try:
        return unquote(url, errors="strict")
    except UnicodeDecodeError:
        return url


def _terms(df: DataFrame, strict: list[str], soft: list[str]) -> DataFrame:
    """df with n_strict and n_soft, the different terms of either kind in column _url."""
    kinds = dict.fromkeys(soft, 1) | dict.fromkeys(strict, 0)
    table = str.maketrans(UPPER, LOWER)
    inside = set(LOWER + "0123456789")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, kind in kinds.items():
            automaton.add_word(term, (term, kind))
        automaton.make_automaton()
        for batch in batches:
            found = []
            for url in batch.column(batch.schema.get_field_index("_url")).to_pylist():
                url = decoded(url or "").translate(table)
                met: tuple[set, set] = (set(), set())
                for end, (term, kind) in automaton.iter(url):
                    start = end - len(term)
                    if (start < 0 or url[start] not in inside) and (end + 1 == len(url) or url[end + 1] not in inside):
                        met[kind].add(term)
                found.append((len(met[0]), len(met[1])))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))], [*batch.schema.names, "n_strict", "n_soft"])

    schema = type(df.schema)([*df.schema.fields])
    return df.mapInArrow(run, schema.add("n_strict", "long").add("n_soft", "long"))


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple] = RULES, strict: list[str] = STRICT, soft: list[str] = SOFT) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, n_soft), a row for each row of pages.

    rule: the longest that fits, as host and path, or null; verdict: allow or
    block.  A null or empty URL has no terms and is allowed.  Other columns,
    the pages' text among them, are not read.
    """
    host, path = host_and_path(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_url")).withColumns({"host": host, "path": path})
    hit, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        hit, verdict = F.when(fits, F.lit(h + p)).otherwise(hit), F.when(fits, F.lit(what)).otherwise(verdict)
    own = F.when((F.col("n_strict") > 0) | (F.col("n_soft") >= SOFT_LIMIT), "block").otherwise("allow")
    return _terms(rows, strict, soft).select("page_id", "host", "path", hit.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n_strict", "n_soft")
