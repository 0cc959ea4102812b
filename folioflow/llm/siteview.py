"""Main text of web pages by a site style tree.

A page is parsed into branches (tag and class names along the path). The trees of all pages of a host are merged: for each branch the
styles in which its children come (presentation) and the texts of its leaves (content) are counted over the pages. A branch whose style
and texts repeat from page to page has low entropy and so low importance; one that differs everywhere is important. Importance of a
branch = (1 - D**n) of its own part + D**n of its children's mean (n: number of styles seen), as in site style trees; a leaf has the
entropy of its texts. Hosts with few pages lean on the merged tree of all hosts (weight BACKOFF pages), so a menu is known as one on a
host's only page too; where a host has enough pages its own counts decide, whatever the path is elsewhere. All hosts' tree in its turn
leans on 1 (weight BACKOFF pages), so a branch that few pages have stays. A leaf is no more important than its texts are rare: 1 where no
other page has them on that branch, 0 where all pages of all hosts do (logarithms of counts, as in the entropy). So texts dealt from a
pool to many hosts, such as adverts, go even where a host shows each but once. Pages of a host with the same text outside the elements that
go anyway count once, and once over all hosts, so copies do not lower importance.

Branches below IMPORTANCE go, with all below them. Elements that are never an article's text by HTML's own meaning (scripts, styles,
controls, navigation, asides, page headers and footers) go in any case. Forms and blocks named as adverts, menus, notices or comments
go as well, as on a host with few and unlike pages no count can tell them, but a name is a prior only: what holds the page's article or
main element (of several, those in the fewest such blocks) is not condemned by it, and on pages without one a leaf stays if its host's
counts, leaning on 0 (weight BACKOFF pages), are above IMPORTANCE in a form and NAMED_IMPORTANCE in a named block. The rest is the text.

The tree's counts are pre-aggregated per task, so a host with a third of all pages is no hot key; texts of leaves are counted by hash.
The finished tree (a row per host, with the branches that go or stay) is broadcast if it has BROADCAST_BYTES at most and joined by host
otherwise.

Defined cases: null and empty pages have the text '' ; pages without a host form one host; repeated pages each get a row; broken
markup is read leniently (unclosed and stray tags, cut ends); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import bounded_batches, materialise

IMPORTANCE = 0.6
#: More than texts drawn from a pool, such as adverts, have over the pages of a host.
NAMED_IMPORTANCE = 0.9
BACKOFF = 20
DAMPING = 0.9
#: Bytes of the branches that a broadcast may hold.
BROADCAST_BYTES = 32_000_000
#: Open elements beyond which a branch counts with the one around it, and letters beyond which names are told apart by a hash.
DEPTH = 200
#: Last step of the path of an element's own texts, so that they can go without what else is in it.
LEAF = "/#"
LONG_NAME = 80

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe plaintext".split())
NEVER = frozenset("head script style noscript template iframe object svg math canvas button select option textarea input label fieldset nav aside footer menu dialog audio video map noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("option td th tr tbody thead tfoot caption legend li dd dt head html body".split())
#: Class and id words of blocks that are no article text, unless an article in them or counts say otherwise.
NAMED = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay subscribe newsletter signup login social share sharing related recommended recommendations widget comment comments commentlist disqus respond reply replies toolbar pagination pager skip skiplink copyright legal disclaimer".split()
)

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|![^>]*(?:>|\Z)|\?[^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z))", re.S)
_CLASS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_BLANKS = re.compile(r"\s+")
#: How far a block is condemned: not, by a form around it, by a name around it, in any case.
CLEAR, FORM, NAME, ALWAYS = range(4)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar".split())


def _collapse(parts: list[str]) -> str:
    return _BLANKS.sub(" ", htmllib.unescape("".join(parts))).strip()


def parse(page: str) -> list[tuple[str, int, str]]:
    """(path, never, text) of each block with text, in page order, and (path, never, '') of each element opened. never: CLEAR, or how far what it lies in condemns it."""
    out: list[tuple[str, tuple[int, ...], str]] = []
    # of each open element, the blocks that condemn it: indexes into levels, or 0 for one that does so in any case
    stack: list[tuple[str, str, tuple[int, ...]]] = [("", "", ())]
    levels = [ALWAYS]
    mains: list[tuple[int, ...]] = []
    held: list[str] = []
    at, n = 0, len(page)

    def flush() -> None:
        if held:
            text = _collapse(held)
            if text:
                i = len(stack) - 1
                while i > 0 and stack[i][0] not in BLOCK:
                    i -= 1
                out.append((stack[i][1] + LEAF, stack[-1][2] if i else (), text))
            held.clear()

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if not name:
            continue
        name = name.lower()
        if m.group(1):
            if name in BLOCK:
                flush()
            elif any(s[0] == name and s[2] for s in stack[-3:]):
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] in ("td", "th", "table") and name not in ("table", "tr", "tbody", "thead", "tfoot") or stack[i][0] in ("article", "main", "body") and name not in BLOCK:
                    break
            continue
        if name in VOID:
            held.append(" ")
            if name == "hr":
                flush()
            continue
        if name in BLOCK or name in NEVER:
            flush()
        if name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK:
                    break
        elif name in ("li", "dd", "dt", "option", "tr", "td", "th"):
            same = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}.get(name, (name,))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in same:
                    del stack[i:]
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        names = ""
        level = FORM if name == "form" else CLEAR
        never = name in NEVER or name == "header" and not any(s[0] in ("article", "main", "section") for s in stack)
        attributes = m.group(3)
        if attributes:
            got = " ".join(x or y or z for x, y, z in _CLASS.findall(attributes))
            if got:
                low = [w.lower() for w in _WORD.findall(got)]
                names = "." + ".".join(sorted(set(low)))
                if len(names) > LONG_NAME:
                    names = ".." + hashlib.blake2b(names.encode(), digest_size=8).hexdigest()
                if name not in ("html", "body", "article", "main"):
                    if not NAMED.isdisjoint(low) or not _ROLES.isdisjoint(low):
                        level = NAME
            if re.search(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", attributes, re.I):
                never = True
        parent = stack[-1]
        path = f"{parent[1]}/{name}{names}"
        if name in RAW:
            end = re.compile(rf"</{name}\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        causes = parent[2]
        if never:
            causes = (*causes, 0)
        elif level:
            # text before an inline element is not in it
            flush()
            causes = (*causes, len(levels))
            levels.append(level)
        stack.append((name, path if len(stack) <= DEPTH else parent[1], causes))
        if name in ("article", "main") and 0 not in causes:
            mains.append(causes)
        if name in BLOCK:
            out.append((stack[-1][1], causes, ""))
    flush()
    least = min(map(len, mains), default=0)
    cleared = {i for causes in mains if len(causes) == least for i in causes}

    def judged(causes: tuple[int, ...]) -> int:
        left = [levels[i] for i in causes if i not in cleared]
        return ALWAYS if left and mains else max(left, default=CLEAR)

    return [(path, judged(causes) if causes else CLEAR, text) for path, causes, text in out]


def host_of(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _features(page: str | None) -> tuple[str, list[tuple[str, str, bool, bool, int]]]:
    """What pages that are copies of each other share, and (path, text of a leaf or style of a branch, whether it is content, whether it is the first such row of its path, how far a name or form condemns it) of a page, each once."""
    blocks = parse(page) if page else []
    out: dict = {}
    children: dict[str, list[str]] = {}
    for path, never, text in blocks:
        if text:
            out[path, text, True] = max(out.get((path, text, True), CLEAR), never % ALWAYS)
        else:
            parent, _, own = path.rpartition("/")
            kinds = children.setdefault(parent, [])
            if not kinds or kinds[-1] != own:
                kinds.append(own)
    for path, kinds in children.items():
        if path:
            out[path, " ".join(kinds), False] = CLEAR
    met: set = set()
    rows = []
    for (path, text, content), level in out.items():
        rows.append((path, text, content, (path, content) not in met, level))
        met.add((path, content))
    same = "\n".join(f"{path} {text}" for path, never, text in blocks if text and never != ALWAYS)
    return same or page or "", rows


def style_tree(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, path, importance, pages, level, named) of each branch, hosts with few pages leaning on all hosts' tree; named: importance of a leaf that a name or form (level) condemns, on its host's pages only."""
    import xxhash

    bounded_batches(pages.sparkSession)
    kinds = [("path", pa.string()), ("feature", pa.int64()), ("content", pa.bool_()), ("first", pa.bool_()), ("level", pa.int32())]

    def run(batches):
        for b in batches:
            same, ends, rows = [], [0], []
            for page in b.column(1).to_pylist():
                key, found = _features(page)
                same.append(xxhash.xxh64_intdigest(key) - 2**63)
                rows += [(path, xxhash.xxh64_intdigest(text) - 2**63, content, first, level) for path, text, content, first, level in found]
                ends.append(len(rows))
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            fields = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], [k for k, _ in kinds])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)], ["host", "same", "features"])

    seen = pages.select(host_of(url).alias("host"), F.col(html).alias("html")).mapInArrow(run, "host string, same long, features array<struct<path string, feature long, content boolean, first boolean, level int>>")
    once = materialise(seen.dropDuplicates(["host", "same"]), "features")
    # each step is written, as one plan of all of them takes the driver more memory than the steps' tables take disk
    own = materialise(_counts(once, ["host"]), "counts")
    general = materialise(_counts(once.dropDuplicates(["same"]), []), "all-counts")
    mine, all_ = _importance(own, ["host"]), _importance(general, [])
    all_ = all_.select("path", _leaning("importance", "pages", F.lit(1.0)).alias("general"), F.col("pages").alias("all_pages"))
    # how often a host's texts stand on the branch anywhere
    seen_n = general.filter("content").select("path", "feature", F.log("n").alias("_log"))
    spread = own.filter("content").join(seen_n, ["path", "feature"], "left").groupBy("host", "path").agg((F.sum(F.col("n") * F.coalesce("_log", F.lit(0.0))) / F.sum("n")).alias("_log"))
    both = mine.join(all_, "path").join(spread, ["host", "path"], "left")
    rare = F.when(F.col("all_pages") > 1, 1 - F.coalesce("_log", F.lit(0.0)) / F.log("all_pages")).otherwise(F.lit(1.0))
    both = both.withColumn("rare", rare).withColumn("rare", _leaning("rare", "all_pages", F.lit(1.0)))
    mixed = F.least(_leaning("importance", "pages", F.col("general")), F.when(F.col("is_leaf"), F.col("rare")).otherwise(F.lit(1.0)))
    both = both.select("host", "path", mixed.alias("mixed"), "is_leaf", "pages", "level", F.least(_leaning("importance", "pages", F.lit(0.0)), "rare").alias("named"))
    both = materialise(both, "branches")
    # a branch never goes while one of its leaves is important
    best = both.filter("is_leaf").select("host", "mixed", F.explode(_ancestors()).alias("path")).groupBy("host", "path").agg(F.max("mixed").alias("best"))
    return both.join(best, ["host", "path"], "left").select("host", "path", F.greatest("mixed", "best").alias("importance"), "pages", "level", "named")


def _leaning(value: str, pages: str, on: F.Column) -> F.Column:
    return (F.col(pages) * F.col(value) + F.lit(BACKOFF) * on) / (F.col(pages) + F.lit(BACKOFF))


def _ancestors() -> F.Column:
    """path and all branches above it."""
    return F.expr("transform(sequence(1, size(split(path, '/')) - 1), i -> concat('/', array_join(slice(split(path, '/'), 2, i), '/')))")


def _counts(once: DataFrame, by: list[str]) -> DataFrame:
    """(by, path, content, feature, n, n_first, level): n pages have the feature, n_first of them as their path's first, so that n_first adds up to pages."""
    rows = once.select(*by, F.explode("features").alias("f")).select(*by, "f.*")
    return rows.groupBy(*by, "path", "content", "feature").agg(F.count("*").alias("n"), F.count_if("first").alias("n_first"), F.max("level").alias("level"))


def _importance(counts: DataFrame, by: list[str]) -> DataFrame:
    """Importance of each branch from (by, path, content, feature, n, n_first, level), whether it is a leaf, its pages and level.

    The entropy, base m, of the texts of a leaf or of the styles of a branch over its m occurrences: 1 where all differ, 0 where all are equal.
    """
    g = counts.groupBy(*by, "path", "content").agg(
        F.sum("n").alias("m"), F.count("*").alias("k"), F.sum(F.col("n") * F.log("n")).alias("n_log_n"), F.sum("n_first").alias("pages"), F.max("level").alias("level")
    )
    log_m = F.log("m")
    entropy = F.when(F.col("m") > 1, 1 - F.col("n_log_n") / F.col("m") / log_m).otherwise(F.lit(1.0))
    own = materialise(g.select(*by, "path", "content", "m", "k", "pages", "level", entropy.alias("own")), "entropies")
    leaf = own.filter("content").select(*by, "path", F.col("own").alias("leaf"), F.col("m").alias("leaf_m"), F.col("pages").alias("leaf_pages"), "level")
    node = own.filter("NOT content").select(*by, "path", F.col("own").alias("node"), F.col("pages").alias("node_pages"), F.col("k").alias("styles"))
    x = leaf.join(node, [*by, "path"], "full")
    # what lies below a branch: its leaves' importance by their occurrences
    up = leaf.select(*by, "leaf", "leaf_m", F.explode(_ancestors()).alias("path"))
    below = up.groupBy(*by, "path").agg((F.sum(F.col("leaf") * F.col("leaf_m")) / F.sum("leaf_m")).alias("below"))
    x = x.join(below, [*by, "path"], "left")
    d = F.pow(F.lit(DAMPING), F.coalesce(F.col("styles"), F.lit(0)))
    mixed = (1 - d) * F.coalesce(F.col("node"), F.lit(0.0)) + d * F.coalesce(F.col("below"), F.lit(0.0))
    # a leaf's texts decide, not the styles of what lies beside them
    is_leaf = F.col("leaf").isNotNull()
    return x.select(*by, "path", F.coalesce("leaf", mixed).alias("importance"), is_leaf.alias("is_leaf"), F.coalesce("leaf_pages", "node_pages").alias("pages"), F.coalesce("level", F.lit(CLEAR)).alias("level"))


def main_text(page: str | None, gone: frozenset[str] | set[str], stays: frozenset[str] | set[str] = frozenset()) -> str:
    """Text of a page without the branches in gone; leaves in stays are important, whatever name or form is around them."""
    if not page:
        return ""
    out = []
    for path, never, text in parse(page):
        if text and (not never or never != ALWAYS and path in stays) and not (gone and _below(path, gone)):
            out.append(text)
    return "\n".join(out)


def _below(path: str, gone) -> bool:
    while path:
        if path in gone:
            return True
        path = path.rpartition("/")[0]
    return False


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", importance: float = IMPORTANCE) -> DataFrame:
    """A row per row of pages: id, url, text, n_chars."""
    spark = pages.sparkSession
    bounded_batches(spark)
    tree = style_tree(pages, html, url)
    goes = F.col("importance") < importance
    stays = (F.col("level") > CLEAR) & (F.col("named") >= F.when(F.col("level") == FORM, importance).otherwise(NAMED_IMPORTANCE))
    low = tree.filter(goes | stays).groupBy("host").agg(F.collect_set(F.when(goes, F.col("path"))).alias("gone"), F.collect_set(F.when(stays, F.col("path"))).alias("stays"))
    low = materialise(low, "low-branches")
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), host_of(url).alias("host"), F.col(html).alias("html"))
    size = low.agg(F.sum(sum(F.aggregate(c, F.lit(0), lambda a, x: a + F.octet_length(x) + 16) for c in ("gone", "stays")))).first()[0] or 0
    low = F.broadcast(low) if size <= BROADCAST_BYTES else low
    joined = rows.join(low, "host", "left").select("id", "url", "gone", "stays", "html")

    def run(batches):
        sets: dict = {}
        for b in batches:
            texts = []
            for gone, stays, page in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                key = tuple(gone or ()), tuple(stays or ())
                if len(sets) > 1000:
                    sets.clear()
                if key not in sets:
                    sets[key] = frozenset(key[0]), frozenset(key[1])
                texts.append(main_text(page, *sets[key]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)[id]
    return joined.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id)
