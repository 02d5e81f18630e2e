"""Main text of HTML pages: structure first, a suffix array per host for what structure leaves open.

A page's marks say of most blocks what they are: those in an article (else in the main element) are text, those in
menus, headers, footers, asides, forms, scripts, adverts, notices and comments go. What the marks leave open is told apart by
repetition: the token streams of a host's pages are concatenated, their suffixes sorted, and token runs that stand on
several distinct pages are boilerplate. Open are the blocks of pages with neither an article nor a main element, of which the runs
that only this page has are its text, and blocks inside an article under a class or id that names neither prose nor a
known page part: such a block goes when all of it is repeated. The search runs over these and over all blocks that the marks of the
host's pages leave out, so that the menu of a marked page is known on an unmarked one. Marks guard the other blocks of an article:
they are never thinned out nor held against others, as a passage that two articles share is part of both.
The pages of a host beyond ``SHARD_CHARS`` are dealt into shards, whose windows of ``RUN`` tokens are counted by (host, hash of 64
bits): the result is that of one shard.
"""

from __future__ import annotations

import hashlib
import html
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelake.llm.textkit import U, mix
from estatelake.llm.url_rules import host_of
from estatelake.session import stored

#: shortest token run that counts as boilerplate when several pages of a host have it
RUN = 8
PAGES = 2
#: characters of blocks whose suffixes are sorted together; the shards of a larger host exchange hashes of their windows
SHARD_CHARS = 2_000_000

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^>]*\Z", re.S)
ATTR = re.compile(r"([A-Za-z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
# fixed values: HTML's element names by role, and usual names of page parts
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe xmp noembed noframes".split())
DROP = set("nav footer aside form head button select dialog menu svg object video audio canvas map".split())
BLOCK = set("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var p li td th tr dd dt option".split())
DROP_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
DROP_NAMES = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice popup modal newsletter subscribe signup login social share sharing related recommended comment comments respond disqus reply replies widget pager pagination toolbar skip".split())
#: names of elements inside an article that hold its prose or only lay it out; blocks under other names are not guarded
PROSE_NAMES = set("article articlebody body col column container content contents entry excerpt figure headline inner intro lead main page post prose row section story text title wrap wrapper".split())
#: elements that end where the next of them begins
ITEMS = set("li td th tr dd dt option".split())
OPENING = {"comment", "comments", "respond", "disqus", "reply", "replies", "related", "recommended"}


def _role(name: str, attrs: str, inside: bool) -> tuple[bool, bool, bool, set[str]]:
    """(drop, region, final, names): to be dropped, an article or main element, dropped with all regions in it; its class names and id."""
    found = {}
    for m in ATTR.finditer(attrs) if attrs.strip(" /") else ():
        found.setdefault((m[1] or m[5]).lower(), (m[2] or m[3] or m[4] or "").lower())
    names = set(re.split(r"[\s_-]+", f"{found.get('class', '')} {found.get('id', '')}")) - {""}
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    final = bool(names & OPENING) or hidden or name == "aside"
    drop = final or name in DROP or found.get("role") in DROP_ROLES or bool(names & DROP_NAMES) or not inside and (name == "header" or "header" in names)
    region = name in ("article", "main") or found.get("role") in ("main", "article") or found.get("itemprop") == "articlebody"
    return drop, region and not final, final, names


def blocks(page: str) -> tuple[list[str], list[int], list[str], list[str]]:
    """(main, loose, open, aside): blocks of the article or main element, which of them no mark guards, else the blocks that no
    mark decides, and the blocks that the marks leave out."""
    kept: dict[str, list[tuple[str, bool]]] = {"article": [], "main": [], "": [], "drop": []}
    stack: list[tuple[str, str, tuple]] = []  # element, "drop", "final", "article", "main", "loose", "prose" or "", counts below
    drops = finals = articles = mains = loose = 0
    buffer: list[str] = []

    def flush():
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                kept["drop" if drops else "article" if articles else "main" if mains else ""].append((text, loose > 0))

    def push(name: str, kind: str):
        nonlocal drops, finals, articles, mains, loose
        # a region inside a dropped element that is not final shows that element to be a wrapper or unclosed
        stack.append((name, kind, (drops, finals, articles, mains, loose)))
        if kind in ("article", "main"):
            drops = 0
        if kind in ("article", "main", "prose"):
            loose = 0
        loose += kind == "loose"
        drops += kind in ("drop", "final")
        finals += kind == "final"
        articles += kind == "article"
        mains += kind == "main"

    def pop():
        nonlocal drops, finals, articles, mains, loose
        drops, finals, articles, mains, loose = stack.pop()[2]

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        text = page[at: m.start() if m else n]
        if text:
            buffer.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            if name in BLOCK:
                flush()
            if any(s[0] == name for s in stack):
                flush()
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in RAW:
            close = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            at = page.find(">", close.end() - 1) + 1 if close else n
            at = at or n
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                buffer.append(" ")
            continue
        if name in BLOCK:
            flush()
            if stack and (stack[-1][0] == "p" or name in ITEMS and stack[-1][0] == name):
                pop()
        drop, region, final, names = _role(name, m["attrs"] or m["attrs2"] or "", articles > 0 or mains > 0)
        if region and not finals:
            flush()
            push(name, "main" if name == "main" or name not in ("article",) and "main" in (m["attrs"] or "").lower() else "article")
        elif drop:
            flush()
            push(name, "final" if final else "drop")
        elif names and name in BLOCK and (articles or mains):
            push(name, "prose" if names & PROSE_NAMES else "loose")
        elif name not in INLINE:
            push(name, "")
    flush()
    main = kept["article"] or kept["main"]
    texts = lambda *kinds: [t for k in kinds for t, _ in kept[k]]
    aside = texts("drop", *(("main",) if kept["article"] else ()), *(("",) if main else ()))
    return [t for t, _ in main], [i for i, (_, x) in enumerate(main) if x], [] if main else texts(""), aside


PARSED = pa.struct([("kept", pa.list_(pa.string())), ("loose", pa.list_(pa.int32())), ("open", pa.list_(pa.string())), ("aside", pa.list_(pa.string())), ("same", pa.int64())])


def _parsed(column: pa.Array) -> pa.Array:
    out = []
    for page in column.to_pylist():
        parts = blocks(page) if page else ([], [], [], [])
        # pages with equal blocks are one page
        same = hashlib.blake2b("\n".join(chain(parts[0], ["\f"], parts[2], ["\f"], parts[3])).encode("utf-8", "surrogatepass"), digest_size=8).digest()
        out.append((*parts, int.from_bytes(same, "big", signed=True)))
    return pa.StructArray.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(PARSED)], names=PARSED.names)


def repeated_tokens(tokens: np.ndarray, page: np.ndarray, run: int = RUN, pages: int = PAGES) -> np.ndarray:
    """Which tokens stand in a run of ``run`` tokens that occurs on ``pages`` distinct pages or more.

    ``tokens``: small numbers, the pages one after another. Suffixes are sorted by their first ``run`` tokens, doubling the
    sorted length; suffixes with equal beginnings are neighbours then.
    """
    n = len(tokens)
    rank, length = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1, 1
    end = np.searchsorted(page, page, side="right")  # where the suffix's page ends
    while length < run:
        step = min(length, run - length)
        after = np.zeros(n, np.int64)
        has = np.arange(n) + step < end
        after[has] = rank[np.flatnonzero(has) + step]
        rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1] + 1
        length += step
    whole = np.arange(n) + run <= end
    order = np.lexsort((page, rank))
    r, p = rank[order], page[order]
    new = np.concatenate(([True], r[1:] != r[:-1]))
    distinct = np.add.reduceat((new | np.concatenate(([True], p[1:] != p[:-1]))).astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
    start = np.zeros(n, bool)
    start[order] = distinct >= pages
    start &= whole
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(start)
    np.add.at(cover, at, 1)
    np.add.at(cover, np.minimum(at + run, n), -1)
    return np.cumsum(cover[:-1]) > 0


def _tokens(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[str]]:
    """(words, block of each word, row of each word, row of each block, text of each block) of all blocks of the rows."""
    of, texts, block, words = [], [], [], []
    for i, parts in enumerate(zip(rows["open"], rows["held"], rows["aside"])):
        for t in chain(*parts):
            for w in ["\n", *t.split(" "), "\n"]:
                block.append(len(texts)), words.append(w)
            of.append(i), texts.append(t)
    block = np.array(block, np.int64)
    return np.array(words, object), block, np.array(of, np.int64)[block], of, texts


def _window_hashes(words: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``run`` words within a page and their hashes, which agree in all shards."""
    codes, values = pd.factorize(words)
    single = np.array([_hash(w) for w in values], U)[codes] if len(codes) else np.zeros(0, U)
    at = np.flatnonzero(np.arange(len(words)) + run <= np.searchsorted(page, page, side="right"))
    h = np.zeros(len(at), U)
    for k in range(run):
        h = mix(h + single[at + k] + U(k + 1))
    return at, h


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def _windows(run: int):
    """Pages of a shard to its distinct windows and short blocks, each with the number of its pages in the shard."""
    def fn(rows: pd.DataFrame) -> pd.DataFrame:
        words, _, page, of, texts = _tokens(rows)
        at, h = _window_hashes(words, page, run)
        short = [(i, _hash("\n" + t)) for i, t in zip(of, texts) if len(t.split(" ")) < run]
        h = np.concatenate((h, np.array([x for _, x in short], U))).view(np.int64)
        counted = pd.DataFrame({"window": h, "page": np.concatenate((page[at], np.array([i for i, _ in short], np.int64)))}).drop_duplicates().groupby("window").size()
        return pd.DataFrame({"host": rows["host"].iloc[0], "shard": rows["shard"].iloc[0], "window": counted.index, "n": counted.to_numpy()})

    return fn


def _results(rows: pd.DataFrame, words: np.ndarray, block: np.ndarray, covered: np.ndarray, short: list[bool]) -> pd.DataFrame:
    """The text of each page's open blocks and the numbers of its held blocks that go, given the words and blocks that are repeated."""
    left: dict[int, list[str]] = {}
    for k, w, c in zip(block.tolist(), words, covered):
        if not c and w != "\n" and not short[k]:
            left.setdefault(k, []).append(w)
    out, k = [], 0
    for own, held, aside in zip(rows["open"], rows["held"], rows["aside"]):
        text = "\n".join(" ".join(left[b]) for b in range(k, k + len(own)) if b in left)
        k += len(own)
        out.append((text, [n for n in range(len(held)) if k + n not in left]))
        k += len(held) + len(aside)
    return pd.DataFrame({"host": rows["host"].array, "same": rows["same"].array, "text": [t for t, _ in out], "gone": [g for _, g in out]})


def _unique_runs(run: int, pages: int):
    """Distinct pages (host, same, open, held, aside) of a host that is one shard to their results."""
    def fn(rows: pd.DataFrame) -> pd.DataFrame:
        words, block, page, of, texts = _tokens(rows)
        covered = repeated_tokens(pd.factorize(words)[0], page, run, pages) if len(words) else np.zeros(0, bool)
        # a whole block that is shorter than a run counts when other pages have the same block
        counts = pd.DataFrame({"page": of, "text": texts}).drop_duplicates().groupby("text").size()
        return _results(rows, words, block, covered, [len(t.split(" ")) < run and counts[t] >= pages for t in texts])

    return fn


def _unique_runs_of_shard(run: int):
    """Pages of a shard, and the windows in it that are repeated in the host, to the pages' results."""
    def fn(rows: pd.DataFrame, repeated: pd.DataFrame) -> pd.DataFrame:
        words, block, page, _, texts = _tokens(rows)
        at, h = _window_hashes(words, page, run)
        known = repeated["window"].to_numpy(np.int64).view(U)
        cover = np.zeros(len(words) + 1, np.int64)
        hit = at[np.isin(h, known)]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + run, -1)
        blocks_known = set(known.tolist())
        return _results(rows, words, block, np.cumsum(cover[:-1]) > 0, [len(t.split(" ")) < run and _hash("\n" + t) in blocks_known for t in texts])

    return fn


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, least_pages: int = PAGES) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    White space within a block becomes one space; blocks are joined by one line feed in page order. Null and empty pages, and
    pages without any kept block, have an empty text. Unclosed and malformed tags end where the next block begins; what a cut page
    holds of its article is kept. The only page of a host keeps all its undecided blocks.
    A null url stands for a host of its own. Repeated rows give repeated results; other columns are not read.
    """
    parsed = F.arrow_udf(_parsed, "kept array<string>, loose array<int>, open array<string>, aside array<string>, same long")(F.col(html_col))
    rows = stored(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), parsed.alias("p")).select("page_id", "url", "p.*"), "parsed-pages").withColumn("host", host_of(F.col("url")))
    undecided = "size(open) > 0 or size(loose) > 0"
    done = rows.where(f"not ({undecided})").select("page_id", "url", F.array_join("kept", "\n").alias("text"))
    left = rows.where(undecided)
    # all distinct pages of the hosts that have an undecided one; the hosts are stored first, so that a short list meets the pages without a shuffle
    hosts = stored(left.select("host").distinct(), "undecided-hosts")
    fed = rows.join(hosts, "host", "left_semi").select("host", "same", "open", F.expr("transform(loose, i -> kept[i])").alias("held"), "aside").dropDuplicates(["host", "same"])
    size = lambda column: F.aggregate(column, F.lit(0).cast("long"), lambda s, t: s + F.length(t))
    fed = stored(fed.withColumn("chars", size("open") + size("held") + size("aside")), "fed-pages")
    shards = fed.groupBy("host").agg(F.ceil(F.sum("chars") / SHARD_CHARS).alias("shards"))
    fed = fed.join(shards, "host").withColumn("shard", F.pmod(F.xxhash64("same"), F.greatest("shards", F.lit(1))))
    schema = "host string, same long, text string, gone array<int>"
    found = fed.where("shards <= 1").groupBy("host").applyInPandas(_unique_runs(run, least_pages), schema)
    # a page stands in one shard, so the shards' page counts of a window add up to the host's
    parts = fed.where("shards > 1")
    windows = stored(parts.groupBy("host", "shard").applyInPandas(_windows(run), "host string, shard long, window long, n long"), "page-windows")
    repeated = windows.groupBy("host", "window").agg(F.sum("n").alias("n")).where(F.col("n") >= least_pages).select("host", "window")
    repeated = windows.join(repeated, ["host", "window"], "left_semi").select("host", "shard", "window")
    found = found.union(parts.groupBy("host", "shard").cogroup(repeated.groupBy("host", "shard")).applyInPandas(_unique_runs_of_shard(run), schema))
    kept = F.array_join(F.expr("transform(filter(sequence(1, size(kept)), i -> not array_contains(transform(gone, g -> loose[g] + 1), i)), i -> kept[i - 1])"), "\n")
    text = F.when(F.size("open") > 0, F.col("text")).otherwise(kept)
    return done.union(left.join(found, ["host", "same"]).select("page_id", "url", text.alias("text"))).withColumn("n_chars", F.char_length("text").cast("long"))
