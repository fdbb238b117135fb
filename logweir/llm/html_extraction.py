"""Main text of web pages by equivalence-class template deduction.

Tokens are opening and closing tags with the path of the containers around them. A token's occurrence vector over the pages of its host
is kept as a fingerprint (XOR of mixed page hash and count), which partial aggregation combines, so a host of any size is one small
group. Tokens with equal vectors form an equivalence class; a container is valid if its opening and closing tags share a class, and it
is in the host's template if all containers around it are valid too. Slots are then named: menus, adverts, footers and the like go if
their tags pair on the page, articles stay. A container around an article doesn't drop it unless other articles of the page have fewer
such containers around them (comments are often articles); nor do body and a form that frames the page's parts or all of its paragraphs.
Names of classes count whole, by their last part that says something. Outside of articles a
block of text is template text if it is there on the very pages that have its container, that container is in the template, and other
blocks of the page are not: a page never loses all of its text that way. So the tags' meaning decides on pages with an article, and the
classes decide on the others; hosts with few pages have no classes.

Vectors run over a host's distinct pages: copies of a page count once, whatever their urls.

Defined cases: null html is empty and gives the empty text; pages with a null or unparsable url share no host, so nothing is deduced
for them; repeated rows are extracted alike; an empty table gives an empty table; further columns are ignored. Text outside of tags counts; entities are decoded after
tags are found; comments, scripts and styles never count, also when they are not closed; other raw elements that are not closed hold
nothing. A page's steps are held at once, about ten times its length, so a task needs that much for its longest page.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, sized_broadcast, small_batches, written

# fixed values: the meaning of tags and of words in class, id and role attributes
CONTAINERS = set("html head body nav header footer aside article main section div form ul ol menu dialog table figure noscript".split())
RAW = set("script style textarea title iframe xmp noembed noframes svg math template object select button".split())
#: Raw elements that end with the page if they aren't closed, and those that may close themselves.
LITERAL, FOREIGN = set("script style textarea title iframe xmp noembed noframes".split()), {"svg", "math"}
#: Last parts of compound names that say nothing themselves: the part before them counts.
NEUTRAL = set("area bar body block box button buttons container content inner item items left link links list outer panel right section slot text top unit wrap wrapper".split())
BOILER_TAGS = set("head nav footer aside form menu dialog noscript".split())
BOILER_WORDS = set("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
MAIN_TAGS = {"article", "main"}
#: Containers of all of a page: words of their classes say nothing about the text, and their tags may be left out.
WHOLE = {"html", "body"}
#: Parts of a page: a form that holds one of them is around the page, not in it.
PARTS = MAIN_TAGS | set("nav header footer aside".split())
MAIN_WORDS = set("article content entry main post story".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
PARAGRAPH = re.compile(r"<form\b.*?<p[\s>]", re.S | re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
MASK = (1 << 64) - 1
#: A container is in the template if this share of its host's distinct pages, and so many of them at least, has it.
SUPPORT, LEAST = 0.5, 3


def mixed(a: int, b: int) -> int:
    """Signed 64-bit mix of a page's hash and a count."""
    x = (a ^ (b * 0x9E3779B97F4A7C15)) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    x ^= x >> 31
    return x - (1 << 64) if x >> 63 else x


def label(name: str, attributes: str) -> str:
    """A container's token: its tag with the words of class, id and role."""
    if not attributes:
        return name
    names = {"-".join(re.findall("[a-z]+", w)) for m in NAMES.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()}
    return ".".join([name, *sorted(names - {""})])


def meant(name: str) -> str:
    """What a name of a class, id or role is about: its last part that says something ("site-footer", "comment-list", "social-science")."""
    parts = name.split("-")
    while len(parts) > 1 and parts[-1] in NEUTRAL:
        parts.pop()
    return parts[-1]


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", "", raw) and ("open" or "close", tag, attributes) in order; raw elements are left out whole."""
    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            yield "close", name, ""
        elif name in FOREIGN and (m[3] or m[6] or "").endswith("/"):
            continue
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page) if name in LITERAL else at  # others that aren't closed hold nothing
        else:
            yield "open", name, m[3] or m[6] or ""


def walk(page: str) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """Events with the path of open containers: ("open" | "close", path), ("break", ...), ("text", raw, path)."""
    stack: list[str] = []
    for kind, name, rest in events(page):
        if kind == "text":
            yield "text", rest, tuple(stack)
            continue
        if name in BLOCKS:
            yield "break", "", tuple(stack)
        elif name == "br":
            yield "text", " ", tuple(stack)
        if name not in CONTAINERS:
            continue
        if kind == "open":
            stack.append(label(name, rest))
            yield "open", "", tuple(stack)
        else:
            at = next((i for i in range(len(stack) - 1, -1, -1) if tag(stack[i]) == name), -1)
            if at >= 0:
                yield "close", "", tuple(stack[: at + 1])
                del stack[at:]


def squeezed(raw: str) -> str:
    return " ".join(entities.unescape(raw).split())


def blocks(steps: Iterable[tuple[str, str, tuple[str, ...]]]) -> Iterator[tuple[tuple[str, ...], str]]:
    """(path, text) of the non-empty blocks of a walk in order; a block ends at block tags and where the path changes."""
    parts: list[str] = []
    at: tuple[str, ...] = ()
    for kind, raw, path in steps:
        if kind == "text" and (path == at or not parts):
            parts.append(raw)
            at = path
            continue
        if text := squeezed("".join(parts)):
            yield at, text
        parts = [raw] if kind == "text" else []
        at = path
    if text := squeezed("".join(parts)):
        yield at, text


def tag(token: str) -> str:
    return token.split(".", 1)[0]


def named(token: str, tags: set[str], words: set[str]) -> bool:
    name, *rest = token.split(".")
    return name in tags or not words.isdisjoint(map(meant, rest))


class Page:
    """A page's walk, which of its containers close, and where its blocks are."""

    def __init__(self, page: str):
        self.steps = list(walk(page))
        self.opened, self.closed = Counter(), Counter()
        for kind, _, path in self.steps:
            if kind == "open":
                self.opened[path] += 1
            elif kind == "close":
                self.closed[path] += 1
        self.forms = {p for p in self.opened if tag(p[-1]) == "form"}
        self.frames = {p[: i + 1] for p in self.opened if tag(p[-1]) in PARTS for i, t in enumerate(p[:-1]) if tag(t) == "form"}

    def found(self, template: dict[tuple[str, ...], bool]) -> list[tuple[str, int, tuple[str, ...], str]]:
        """(kind, boilerplate containers around, path, text) of the blocks that no boilerplate holds."""
        places: dict[tuple[str, ...], tuple[str, int]] = {}
        out = []
        for path, text in blocks(self.steps):
            if path not in places:
                places[path] = self.place(path, template)
            if places[path][0] != "dropped":
                out.append((*places[path], path, text))
        return out

    def place(self, path: tuple[str, ...], template: dict[tuple[str, ...], bool]) -> tuple[str, int]:
        """("article" | "named" | "other" | "dropped", boilerplate containers around the article)."""
        article = main = next((i for i, t in enumerate(path) if named(t, MAIN_TAGS, set())), -1)
        if main < 0:  # a class may name the content if the host's template has that container
            main = next((i for i, t in enumerate(path) if tag(t) not in WHOLE and named(t, set(), MAIN_WORDS) and not named(t, BOILER_TAGS, BOILER_WORDS) and template.get(path[: i + 1], True)), -1)
        around = 0
        for i, t in enumerate(path):
            # a header belongs to the page unless an article holds it
            if i == article or not named(t, BOILER_TAGS | ({"header"} if main < 0 or i < main else set()), set() if tag(t) in WHOLE else BOILER_WORDS):
                continue
            at = path[: i + 1]
            if self.opened[at] != self.closed[at] or at in self.frames:  # if never closed, what it holds is open
                continue
            if i > article:
                return "dropped", 0
            around += 1
        return "article" if article >= 0 else "named" if main >= 0 else "other", around


def content(page: str, template: dict[tuple[str, ...], bool], repeated: set[int]) -> list[str]:
    """Blocks of the main text. template: lasting containers of the host (path -> in valid classes that nest)."""
    own = Page(page)
    found = own.found(template)
    if not found and own.forms and PARAGRAPH.search(page):  # all paragraphs of the page are in a form: it frames them
        own.frames |= own.forms
        found = own.found(template)
    least = min((around for kind, around, _, _ in found if kind == "article"), default=0)
    kept = [(kind, text) for kind, around, _, text in found if kind == "named" or kind == "article" and around == least]
    if kept and not least:
        return [text for _, text in kept]
    # articles within boilerplate only: they don't stand for the text outside of them
    by_name = any(kind == "named" for kind, _ in kept)
    slots = [(kind != "other" or hash_text(path, text) not in repeated, text) for kind, around, path, text in found if (kind == "other" and not by_name) or kind == "named" or kind == "article" and around == least]
    return [text for varies, text in slots if varies] or [text for _, text in slots]


def hash_text(path: tuple[str, ...], text: str) -> int:
    """63-bit hash of a block and its place."""
    raw = ("/".join(path) + "\n" + text).encode("utf-8", "replace")
    return (zlib.crc32(raw) << 31) ^ zlib.adler32(raw)


def observed(df: DataFrame) -> DataFrame:
    """Per host and token: pages, XOR fingerprints of the vectors of the opening tags, of the closing tags and of presence (0 or 1).

    A row with block 0 is a container; others are blocks outside of articles with their container's path. Path "" is the page itself.
    df has distinct pages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[str, str, int], list[int]] = {}
            for host, page_hash, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own, texts, outside = Page(page), set(), {}
                opened, closed = own.opened, own.closed
                for path, text in blocks(own.steps):
                    if path not in outside:
                        outside[path] = own.place(path, {})[0] in ("named", "other")
                    if outside[path]:
                        texts.add(("/".join(path), hash_text(path, text)))
                there = mixed(page_hash, 1)
                for path in opened.keys() | closed.keys():
                    row = found.setdefault((host, "/".join(path), 0), [0, 0, 0, 0])
                    row[1] ^= mixed(page_hash, opened[path])
                    row[2] ^= mixed(page_hash, closed[path])
                    row[0], row[3] = row[0] + 1, row[3] ^ there
                for key in [("", 0), *texts]:
                    row = found.setdefault((host, *key), [0, 0, 0, 0])
                    row[0], row[3] = row[0] + 1, row[3] ^ there
            keys, values = list(found), list(found.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int64())] + [pa.array([v[i] for v in values], pa.int64()) for i in range(4)],
                names=["host", "path", "block", "pages", "opened", "closed", "present"],
            )

    rows = df.mapInArrow(count, "host string, path string, block long, pages long, opened long, closed long, present long")
    return rows.groupBy("host", "path", "block").agg(F.sum("pages").alias("pages"), *[F.bit_xor(c).alias(c) for c in ("opened", "closed", "present")])


def templates(df: DataFrame) -> DataFrame:
    """A row per host: its lasting containers, each valid or not, and its repeated blocks. df: host, h (hash of the page), page."""
    seen = written(observed(df.where("host <> ''").dropDuplicates(["host", "h"])), "tokens")
    totals = seen.where("path = '' and block = 0").select("host", F.col("pages").alias("total"))
    lasting = seen.where(F.col("pages") >= LEAST).join(sized_broadcast(totals, 128), "host").where(F.col("pages") >= F.col("total") * SUPPORT)
    containers = lasting.where("block = 0").select("host", "path", "opened", "closed", "present")
    # a host's tags by vector: a class; a container is valid if both its tags are in one class
    vectors = containers.select("host", "path", "present", F.explode(F.array("opened", "closed")).alias("vector"))
    paired = vectors.groupBy("host", "vector", "path", "present").agg(F.count("*").alias("tags"))
    classes = paired.groupBy("host", "vector").agg(F.collect_list(F.struct("path", "present", (F.col("tags") == 2).alias("valid"))).alias("members"))
    # classes nest where all containers on a path are valid; the page itself (path "", html, body) always is
    paths = classes.groupBy("host").agg(F.flatten(F.collect_list("members")).alias("members"))
    paths = paths.withColumn("open", F.expr("array_distinct(transform(filter(members, m -> not m.valid and not m.path rlike '(^|/)(html|body)([.][^/]*)?$'), m -> m.path))"))
    nests = "not exists(open, o -> o = m.path or startswith(m.path, o || '/'))"
    paths = paths.select("host", F.explode(F.expr(f"array_distinct(transform(members, m -> named_struct('path', m.path, 'present', m.present, 'valid', {nests})))")).alias("m")).select("host", "m.*")
    blocks_ = lasting.where("block <> 0").select("host", "path", "block", "present")
    repeated = blocks_.join(paths.where("valid"), ["host", "path", "present"]).select("host", F.lit(None).cast("struct<path:string,valid:boolean>").alias("token"), "block")
    tokens = paths.where("path <> ''").select("host", F.struct("path", "valid").alias("token"), F.lit(None).cast("long").alias("block"))
    return tokens.unionByName(repeated).groupBy("host").agg(F.collect_list("token").alias("tokens"), F.collect_list("block").alias("repeated"))


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of df: key, url, text, n_chars."""
    small_batches(df.sparkSession)
    host = F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pages = df.select(F.col(key).alias("k"), F.col(url).alias("u"), host.alias("host"), F.coalesce(F.col(html), F.lit("")).alias("page"))
    found = written(templates(pages.select("host", F.xxhash64("page").alias("h"), "page")), "templates")
    size = found.agg(F.sum(64 + F.octet_length("host") + 12 * F.size("repeated") + F.expr("aggregate(tokens, 0, (n, t) -> n + 32 + octet_length(t.path))"))).first()[0] or 0
    joined = pages.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left").select("k", "u", "page", "host", "tokens", "repeated")

    def pulled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, dict, set] | None = None
        for b in batches:
            out = []
            hosts, tokens, repeated = b.column(3).to_pylist(), b.column(4), b.column(5)
            known: dict[str, tuple[dict, set]] = {}
            for i, page in enumerate(b.column(2).to_pylist()):
                if hosts[i] not in known:
                    known[hosts[i]] = last[1:] if last and last[0] == hosts[i] else ({tuple(t["path"].split("/")): t["valid"] for t in tokens[i].as_py() or () if t}, set(repeated[i].as_py() or ()))
                    last = (hosts[i], *known[hosts[i]])
                out.append("\n\n".join(content(page, *known[hosts[i]])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["k", "u", "text"])

    kinds = dict(pages.dtypes)
    out = joined.mapInArrow(pulled, f"k {kinds['k']}, u {kinds['u']}, text string")
    return out.select(F.col("k").alias(key), F.col("u").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))
