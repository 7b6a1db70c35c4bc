"""Main-text extraction with wrappers: union-free regular expressions inferred from pages of the same host.

Inference. A page becomes a token stream of tags and text slots: a slot is a block of text with its inline tags, and
implied end tags are written out. Repeats that stand side by side in it, of any length, are folded into repeated
groups; then the streams of a template (a host, and whether the page marks its article) are aligned one after another,
mismatches becoming optional nodes, unequal repeats one repeated group, and unequal strings text slots. Streams are
first reduced to the distinct ones of a template, each partial wrapper is built from a salted share of them, and the
partial wrappers are aligned in turn, so a host with a third of all pages is not one task's work.
Then every distinct stream is matched against its wrapper, and the wrapper's slots are judged with figures over all
pages of the template: a slot whose string is the same on all of STEADY or more different pages (copies of a page count
once) is part of the template; a slot inside a menu, header, footer, sidebar, notice, advert, form or comment element
is never main text; if the template marks an article, only slots inside it are.

Extraction. Each page's stream is matched against its wrapper, which costs once for each distinct stream of a task;
blocks at kept slots are the text. A block that the match leaves out is judged by its path, as a slot of its own.
Wrappers are broadcast while their total size is at most BROADCAST_BYTES, else they are joined to the pages by template.

Edge cases: null or empty html gives empty text; a null or odd URL belongs to the host ''; unclosed and mismatched tags
are closed by their containers; repeated rows and ids give a row each; an empty table gives an empty result; other
columns are not read. White space includes every character that Python's str.split takes as such. `<br>` is white space.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, text_or_empty

BROADCAST_BYTES = 16 << 20
SALTS = 16
STEADY = 3
MEMO = 2000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg|iframe|object|title|textarea)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base col embed hr img input link meta param source track wbr br".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form button select menu dialog head option fieldset".split())
BOILERPLATE_WORDS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice notices alert popup modal newsletter subscribe signup sidebar rail widget related recommended share social breadcrumb breadcrumbs menu nav navbar navigation header masthead footer copyright comment comments reply replies disqus discussion pagination pager login search form toolbar hidden".split())
BESIDE_WORDS = frozenset("site page box bar bars list block wrap wrapper container section area top bottom left right center button buttons link links post posts article articles story stories item items panel inner outer global primary secondary fixed sticky column col row group icon icons text message body title count toggle tools up in for".split())
ARTICLE = frozenset(["article", "main"])


def names_boilerplate(said: str) -> bool:
    """Whether one of an element's names (class, id, role) says boilerplate: some of its words do, and no word says anything else."""
    for name in said.split():
        words = set(WORD.findall(name))
        if not words.isdisjoint(BOILERPLATE_WORDS) and words <= BOILERPLATE_WORDS | BESIDE_WORDS:
            return True
    return False


def slots(page: str) -> tuple[list[tuple], list[tuple[str, str]]]:
    """The page's token stream, and the block at each of its slots: (path, text). A path names the open containers, boilerplate with `!`."""
    tokens: list[tuple] = []
    blocks: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    at = 0

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                blocks.append(("/".join(x[1] for x in stack), text))
                tokens.append(("#",))

    def close(i: int) -> None:
        tokens.extend((f"/{x[0]}",) for x in reversed(stack[i:]))
        del stack[i:]

    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name, closing = name.lower(), m.group(2)
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            continue
        end_block()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        said = " ".join(x or y or z for x, y, z in NAMED.findall(m.group(4))).lower() if m.group(4) else ""
        words = WORD.findall(said)
        if stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if name == "li" and stack and stack[-1][0] == "li":
            close(len(stack) - 1)
        tokens.append((f"{name}.{'.'.join(words[:3])}" if words else name,))
        if name not in VOID and not m.group(4).endswith("/"):
            bad = name in BOILERPLATE_TAGS or name not in ARTICLE and name not in ("html", "body") and names_boilerplate(said)
            marks = name if name not in ("div", "section") or "main" not in words else "main"
            stack.append((name, f"!{marks}" if bad else marks))
    if at < len(page):
        parts.append(page[at:])
    end_block()
    close(0)
    return tokens, blocks


def fold(tokens: list) -> tuple[list, list[tuple]]:
    """Folds runs that stand side by side, ("+", body) for one or more times body; and the address of each text slot."""
    out: list = []
    places: list[list[tuple]] = []  # for each node, the slots in it: address within the node, number of the slot
    known: dict[tuple, list[int]] = {}
    groups: list[int] = []
    count = 0

    def push(node: tuple, own: list[tuple]) -> None:
        known.setdefault(node, []).append(len(out))
        if node[0] == "+":
            groups.append(len(out))
        out.append(node)
        places.append(own)

    def pop(n: int) -> list[tuple]:
        """The slots of the last n nodes, which go, with addresses within a body of them."""
        own = [((k, *a), i) for k, x in enumerate(places[-n:]) for a, i in x]
        for node in reversed(out[-n:]):
            known[node].pop()
            if node[0] == "+":
                groups.pop()
        del out[-n:], places[-n:]
        return own

    for t in tokens:
        push(t, [((), count)] if t[0] == "#" else [])
        count += t[0] == "#"
        again = True
        while again:
            again = False
            last = len(out) - 1
            near = {last - g for g in groups if len(out[g][1]) == last - g} | {last - i for i in known[out[-1]][:-1] if 2 * (last - i) <= last + 1}
            for n in sorted(near):
                body = out[-n:]
                before = out[-n - 1]
                if before[0] == "+" and list(before[1]) == body:
                    own = pop(n)
                    places[-1] = places[-1] + own
                    again = True
                    break
                if len(out) >= 2 * n and out[-2 * n] == body[0] and out[-2 * n : -n] == body and not (n == 1 and body[0][0] == "+"):
                    second = pop(n)
                    push(("+", tuple(body)), pop(n) + second)
                    again = True
                    break
    addresses = sorted((i, (k, *a)) for k, own in enumerate(places) for a, i in own)
    return out, [a for _, a in addresses]


def core(node: tuple) -> tuple:
    return node[1][0] if node[0] == "?" else node


def head(node: tuple) -> str:
    """What a node is aligned by: its tag, or a group's first tag."""
    node = core(node)
    return node[0] if len(node) == 1 else f"+{head(node[1][0])}"


def single(nodes: list, other: list) -> list[tuple[int, int]]:
    """(place, length) of the parts of nodes: what one turn of a repeated group of `other` covers, else one node each."""
    bodies = [core(x)[1] for x in other if len(core(x)) == 2]
    out, i = [], 0
    while i < len(nodes):
        length = 0
        for body in bodies:
            if len(core(nodes[i])) == 1 and head(nodes[i]) == head(body[0]):
                j = i
                for x in body:
                    if j < len(nodes) and head(nodes[j]) == head(x):
                        j += 1
                    elif x[0] != "?":
                        break
                else:
                    length = max(length, j - i)
        out.append((i, length))
        i += max(1, length)
    return out


def joined(nodes: list, i: int, n: int) -> tuple:
    """The node of a part (place, length) as single() gives it."""
    if not n:
        return nodes[i]
    group = ("+", (core(nodes[i]), *nodes[i + 1 : i + n]))
    return ("?", (group,)) if nodes[i][0] == "?" else group


def align(a: list, b: list) -> list:
    """The wrapper that covers both: equal nodes stay, groups of one head are merged, each other node becomes optional."""
    out: list = []
    a, b = ([joined(x, i, n) for i, n in single(x, [*a, *b])] for x in (a, b))

    def optional(nodes: list) -> None:
        out.extend(("?", (core(x),)) for x in nodes)

    i = j = 0
    for m in SequenceMatcher(None, [head(x) for x in a], [head(x) for x in b], autojunk=False).get_matching_blocks():
        optional(a[i : m.a])
        optional(b[j : m.b])
        for x, y in zip(a[m.a : m.a + m.size], b[m.b : m.b + m.size]):
            both = core(x)
            if len(both) == 2 and both != core(y):
                both = ("+", tuple(align(list(both[1]), list(core(y)[1]))))
            out.append(("?", (both,)) if "?" in (x[0], y[0]) else both)
        i, j = m.a + m.size, m.b + m.size
    return out


def matched(heads: list[str], wrapper: list) -> list[int]:
    """The wrapper's node for each head, -1 for none: fewest heads left out, then fewest nodes missed that are not optional."""
    code: dict[str, int] = {}
    a = np.array([code.setdefault(h, len(code)) for h in heads], np.int64)
    b = np.array([code.setdefault(head(x), len(code)) for x in wrapper], np.int64)
    out_cost = len(b) + 1
    skip = np.r_[0, np.cumsum([x[0] != "?" for x in wrapper])].astype(np.int64)
    rows = [skip]
    for h in a:
        row = rows[-1] + out_cost
        row[1:] = np.minimum(row[1:], np.where(b == h, rows[-1][:-1], row[1:]))
        rows.append(np.minimum.accumulate(row - skip) + skip)
    at, j = [-1] * len(a), len(b)
    for i in range(len(a), 0, -1):
        while j and rows[i][j] == rows[i][j - 1] + skip[j] - skip[j - 1] and not (b[j - 1] == a[i - 1] and rows[i][j] == rows[i - 1][j - 1]):
            j -= 1
        if j and b[j - 1] == a[i - 1] and rows[i][j] == rows[i - 1][j - 1]:
            j -= 1
            at[i - 1] = j
    return at


def place(nodes: list, wrapper: list) -> dict[tuple, tuple]:
    """For the address of every text slot in nodes the wrapper's slot; those that the match leaves out are missing."""
    parts = single(nodes, wrapper)
    joint = [joined(nodes, i, n) for i, n in parts]
    out: dict[tuple, tuple] = {}
    for (i, n), node, j in zip(parts, joint, matched([head(x) for x in joint], wrapper)):
        if j < 0:
            continue
        if node[0] == "#":
            out[(i,)] = (j,)
        elif len(node) == 2:
            for own, slot in place(list(node[1]), list(core(wrapper[j])[1])).items():
                out[(i + own[0], *own[1:]) if n else (i, *own)] = (j, *slot)
    return out


def slot_name(slot: tuple | None, path: str) -> str:
    """A wrapper's slot and the path that it is met at; a path alone is a slot of its own."""
    return f"{'?' + path if slot is None else '.'.join(map(str, slot))}\t{path}"


def shown(nodes) -> str:
    """The wrapper as a union-free regular expression over tags, `#` for a text slot."""
    return " ".join(x[0] if len(x) == 1 else f"({shown(x[1])}){x[0]}" for x in nodes)


def listed(value) -> list:
    """JSON lists back to nodes."""
    return [tuple(x) if len(x) == 1 else (x[0], tuple(listed(x[1]))) for x in value]


def host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m.group(1).lower() if m else ""


def template(url: str | None, blocks: list[tuple[str, str]]) -> str:
    marked = any(not ARTICLE.isdisjoint(path.split("/")) for path, _ in blocks)
    return f"{host(url)} {'marked' if marked else 'plain'}"


def observe(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """Per template: its distinct folded streams, and for the slots of each their string hashes and some of the pages.

    Rows (template, kind, stream, name, low, high, pages): kind 's' has a stream as JSON in name, kind 'p' the address
    and path of one of its slots; pages are the least STEADY hashes of the different pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list] = {}
        for batch in chunks(batches, "html"):
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                tokens, blocks = slots(page)
                key = template(url, blocks)
                nodes, addresses = fold(tokens)
                stream = json.dumps(nodes, separators=(",", ":"))
                mark, own = hashed(stream), hashed(page)
                texts: dict[str, list[str]] = {}
                for address, (path, text) in zip(addresses, blocks):
                    texts.setdefault(slot_name(address, path), []).append(text)
                seen.setdefault((key, "s", mark, stream), [0, 0, []])
                for name, parts in texts.items():
                    h = hashed("\n".join(parts))
                    x = seen.setdefault((key, "p", mark, name), [h, h, []])
                    x[0], x[1] = min(x[0], h), max(x[1], h)
                    if own not in x[2]:
                        x[2] = sorted([*x[2], own])[:STEADY]
            if len(seen) > 20_000:
                yield packed(seen)
                seen = {}
        if seen:
            yield packed(seen)

    def packed(seen: dict) -> pa.RecordBatch:
        template, kind, stream, name = zip(*seen)
        low, high, own = zip(*seen.values())
        return pa.RecordBatch.from_arrays([pa.array(template, pa.string()), pa.array(kind, pa.string()), pa.array(stream, pa.int64()), pa.array(name, pa.string()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["template", "kind", "stream", "name", "low", "high", "pages"])

    source = pages.select(F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    found = source.mapInArrow(run, "template string, kind string, stream long, name string, low long, high long, pages array<long>")
    return found.groupBy("template", "kind", "stream", "name").agg(*figures())


def hashed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def figures() -> list:
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))), 1, STEADY)
    return [F.min("low").alias("low"), F.max("high").alias("high"), least.alias("pages")]


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """template, wrapper (the regular expression), tree (the same as JSON) and kept (JSON list of the main-text slots)."""
    seen = cut(observe(pages, url_col, html_col)).withColumn("salt", F.pmod("stream", F.lit(SALTS)))

    def partial(_, table: pa.Table) -> pa.Table:
        wrapper: list | None = None
        for name in sorted(table.column("name").to_pylist()):
            own = listed(json.loads(name))
            wrapper = own if wrapper is None else align(wrapper, own)
        return pa.table({"template": table.column("template").slice(0, 1), "name": pa.array([json.dumps(wrapper, separators=(",", ":"))])})

    def placed(_, table: pa.Table) -> pa.Table:
        """Slots of the streams of a share to those of the wrapper (the row of kind 'w')."""
        rows = table.to_pylist()
        wrapper = listed(json.loads(next(r["name"] for r in rows if r["kind"] == "w")))
        at = {r["stream"]: place(listed(json.loads(r["name"])), wrapper) for r in rows if r["kind"] == "s"}
        out = []
        for r in rows:
            if r["kind"] == "p":
                address, path = r["name"].split("\t", 1)
                slot, path = slot_name(at[r["stream"]].get(tuple(map(int, address.split(".")))), path).split("\t", 1)
                out.append((r["template"], slot, path, r["low"], r["high"], r["pages"]))
        kinds = [pa.string()] * 3 + [pa.int64()] * 2 + [pa.list_(pa.int64())]
        columns = zip(*out) if out else [[]] * 6
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["template", "slot", "path", "low", "high", "pages"])

    parts = seen.where("kind = 's'").select("template", "salt", "name").groupBy("template", "salt").applyInArrow(lambda k, t: partial(k, t), "template string, name string")
    whole = cut(parts.groupBy("template").applyInArrow(lambda k, t: partial(k, t), "template string, name string"))
    shares = seen.select("template", "salt").distinct().join(whole, "template")
    told = shares.select("template", "salt", F.lit("w").alias("kind"), F.lit(0).cast("long").alias("stream"), "name", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), F.array().cast("array<long>").alias("pages"))
    slot = told.unionByName(seen).groupBy("template", "salt").applyInArrow(lambda k, t: placed(k, t), "template string, slot string, path string, low long, high long, pages array<long>")
    judged = slot.groupBy("template", "slot").agg(*figures(), F.collect_set("path").alias("paths")).select("template", "slot", "low", "high", "pages", F.explode("paths").alias("path"))
    steady = (F.size("pages") >= STEADY) & (F.col("low") == F.col("high"))
    marked = F.col("template").endswith(" marked")
    inside = F.col("path").rlike("(^|/)(article|main)(/|$)")
    judged = judged.where(~steady & (~marked | inside)).withColumn("clear", ~F.col("path").contains("!"))
    # A page can stand in one form as a whole: where nothing else is left of a template, its forms are no boilerplate.
    bare = judged.groupBy("template").agg((~F.max("clear")).alias("bare"))
    judged = judged.join(bare, "template").where(F.col("clear") | (F.col("bare") & ~F.regexp_replace("path", "!form(?=/|$)", "").contains("!")))
    kept = judged.groupBy("template").agg(F.collect_set(F.concat("slot", F.lit("\t"), "path")).alias("kept"))
    regex = F.udf(lambda s: shown(listed(json.loads(s))), "string")
    return whole.join(kept, "template", "left").select("template", regex("name").alias("wrapper"), F.col("name").alias("tree"), F.to_json(F.coalesce("kept", F.array().cast("array<string>"))).alias("kept"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url, text: the main text of every page, by the slots of its template's wrapper."""
    spark = pages.sparkSession
    wrappers = cut(infer(pages, url_col, html_col).select("template", "tree", "kept"))
    source = pages.select(F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    size = wrappers.agg(F.sum(F.length("tree") + F.length("kept") + F.length("template") + 100)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        held = spark.sparkContext.broadcast({r.template: (r.tree, r.kept) for r in wrappers.collect()})
        rows = source.withColumns({"tree": F.lit(None).cast("string"), "kept": F.lit(None).cast("string")})
    else:
        held = None
        of = F.udf(lambda url, page: template(url, slots(page)[1]), "string")
        rows = source.withColumn("template", of("url", "html")).join(wrappers, "template").drop("template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, tuple[list, frozenset]] = {}
        places: dict[tuple, dict] = {}
        for batch in chunks(batches, "html"):
            texts = []
            for url, page, tree, kept in zip(*(batch.column(c).to_pylist() for c in ("url", "html", "tree", "kept"))):
                tokens, blocks = slots(page)
                key = template(url, blocks)
                if len(places) + len(read) > MEMO:
                    read, places = {}, {}
                if key not in read:
                    tree, kept = held.value[key] if held is not None else (tree, kept)
                    read[key] = listed(json.loads(tree)), frozenset(json.loads(kept))
                wrapper, own = read[key]
                nodes, addresses = fold(tokens)
                at = places.get((key, tuple(nodes)))
                if at is None:
                    at = places[key, tuple(nodes)] = place(nodes, wrapper)
                texts.append("\n".join(text for address, (path, text) in zip(addresses, blocks) if slot_name(at.get(address), path) in own))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(texts, pa.string())], ["key", "url", "text"])

    kind = source.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, url string, text string").withColumnRenamed("key", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
