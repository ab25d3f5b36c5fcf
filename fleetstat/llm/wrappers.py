"""Main text of web pages by the paths of their text, with union-free wrappers of hosts beside it.

A page is a stream of block tags and text slots. Wrappers of one host are inferred
step by step: tandem repeats become repeated groups `( )+`, and aligning two
streams turns what one of them lacks into optional groups `( )?`; equal tags stay.
Texts under an article or main element, and those of parts that are never content,
are slots from the start. Other texts travel as digests: equal ones stay, different
ones in one place become a slot. The result is a regular expression without
alternatives. A slot is named by its path of open tags. A page is matched to the
wrapper of its host: texts in none of its groups are template and no content, from
hosts of LEAST pages on; a page that lacks one of them has no template.
Each path is content or not: never under menus, headers, footers,
sidebars, notices, adverts, forms, scripts or reader comments; inside the article
or main element where the page has one; else inside the container, of those the
page has, that holds most text on the host's pages with it. Pages of one host in
different layouts are thus decided each by its own. A page's text is what its
content slots hold.

Distinct streams of a host are counted inside each task before the shuffle, and
aligned in salted parts before the parts' wrappers are aligned, so neither a host
with a third of all pages nor one with many layouts lands in one task as pages.
Hosts' mean lengths by path are joined to the pages, not broadcast by hand.

Defined results: a null or empty page has an empty text; a page without a valid
host belongs to the host of the empty name; repeated pages give repeated results;
other columns are neither read nor returned; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstat.llm.common import slices, text_of, written

# Elements and names by their part in a page.
BLOCKS = frozenset("""html body main article section div header footer nav aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd
table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary center hr head title""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg select button object canvas".split())
SKIPPED = frozenset("nav footer aside form head title dialog menu".split())
#: Never skipped by class or identifier.
WHOLE = frozenset("html body main article".split())
SKIPPED_NAMES = frozenset("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar navigation
sidebar side-bar footer header masthead cookie cookies consent gdpr notice notices alert comment comments disqus reply replies social share sharing
related recommended breadcrumb breadcrumbs pagination pager subscribe subscription newsletter signup login popup modal overlay widget toolbar search""".split())
#: Compounds of the names: a name after one of the first, before one of the second, or several names.
BEFORE = frozenset("site page global main top bottom left right primary secondary mobile google js user reader".split())
AFTER = frozenset("box bar block area container wrapper wrap inner section list item items link links button buttons icon icons row column col slot unit top bottom left right".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
CLOSES_P = BLOCKS - {"html", "body", "head", "title"}
#: A start tag of the first kind ends an open element of the others.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "body": ("head",)}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NUMBER = re.compile(r"\d+(x\d+)?")
_ODD = re.compile(r"[^\w.=-]")
_BLANK = re.compile(r"\s+")
SALT = 32
SLOT = "#"
#: A text of a stream that may yet be template: its digest before the slot.
FIXED = "="
#: Pages of a host from which on text that all of them have is template.
LEAST = 4


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _named(word: str) -> bool:
    """Whether a class or identifier is a name of skipped parts, or a stated compound of one."""
    if word in SKIPPED_NAMES:
        return True
    parts = [p for p in re.split(r"[-_]+", word) if p]
    while len(parts) > 1 and parts[0] in BEFORE:
        parts = parts[1:]
    return bool(parts) and parts[0] in SKIPPED_NAMES and all(p in SKIPPED_NAMES or p in AFTER or _NUMBER.fullmatch(p) for p in parts[1:])


def _signature(tag: str, attributes: str) -> tuple[str, bool]:
    """The tag's name in a stream, and whether it opens a part that is never content."""
    skipped, names = tag in SKIPPED, []
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            words = value.split()
            if key == "role":
                skipped |= value in SKIPPED_ROLES
                names += ["role=main"] if value == "main" else []
            elif key == "hidden":
                skipped = True
            elif key == "aria-hidden":
                skipped |= value.strip() == "true"
            elif key in ("class", "id"):
                skipped |= tag not in WHOLE and any(map(_named, words))
                names += words[:1] if key == "class" else []
    return _ODD.sub("_", tag + "".join(f".{n}" for n in names[:1])), skipped


class _Open:
    __slots__ = ("tag", "name", "skipped")

    def __init__(self, tag, name, skipped):
        self.tag, self.name, self.skipped = tag, name, skipped


def stream(page: str):
    """Yield ('+', name), ('-', name) for block tags and ('#', path, skipped, text) for the text between them."""
    stack: list[_Open] = []
    text: list[str] = []
    at, n = 0, len(page)

    def path():
        return ">".join(e.name for e in stack if e.tag in BLOCKS)

    def flush():
        joined = _BLANK.sub(" ", entities.unescape("".join(text))).strip()
        text.clear()
        return [(SLOT, path(), any(e.skipped for e in stack), joined)] if joined else []

    def close(k):
        out = []
        while len(stack) > k:
            if stack[-1].tag in BLOCKS:
                out += flush()
                out.append(("-", stack[-1].name))
            stack.pop()
        return out

    while at < n:
        start = page.find("<", at)
        if start < 0:
            text.append(page[at:])
            break
        text.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            continue
        found = _TAG.match(page, start) or _LOOSE.match(page, start)
        if not found:
            text.append("<")
            at = start + 1
            continue
        at = found.end()
        closing, tag, attributes = found[1], found[2].lower(), found[3]
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    yield from close(k)
                    break
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = n if end is None else end.end()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCKS:
            yield from flush()
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag == "p":
                        yield from close(k)
                        break
                    if stack[k].tag in BLOCKS:
                        break
            ends = CLOSES.get(tag, ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in ends:
                    yield from close(k)
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "div", "article", "section"):
                    break
        if tag in VOID:
            continue
        name, skipped = _signature(tag, attributes)
        if tag == "header" and not any(e.tag in ("article", "main") for e in stack):
            skipped = True
        stack.append(_Open(tag, name, skipped))
        if tag in BLOCKS:
            yield "+", name
    yield from flush()
    yield from close(0)


# A wrapper is a list of nodes: '<p', '>p', '#' with the slot's path, '=' with a digest before the slot of a text met with
# no other text in its place, or ('?', nodes), ('+', nodes).

def fixed_text(path: str, text: str) -> str:
    return f"{FIXED}{hashlib.blake2b(text.encode(), digest_size=8).hexdigest()}{SLOT}{path}"


def _slot(node: str) -> str:
    return node[node.index(SLOT):] if node.startswith(FIXED) else node


def repeats(nodes: list) -> list:
    """Turn tandem repeats into repeated groups, shortest units first."""
    for size in range(1, 33):
        if size * 2 > len(nodes):
            break
        out, i = [], 0
        while i < len(nodes):
            unit = nodes[i:i + size]
            j = i + size
            while nodes[j:j + size] == unit:
                j += size
            if j > i + size and not (size == 1 and isinstance(unit[0], tuple) and unit[0][0] == "+"):
                out.append(("+", tuple(unit)))
                i = j
            elif j > i + size:
                out.append(unit[0])
                i = j
            elif out and out[-1] == ("+", tuple(unit)):
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def _key(node):
    """Groups align if they begin alike."""
    while isinstance(node, tuple):
        node = node[1][0]
    return _slot(node)


def _unit(nodes: list, i: int) -> list:
    """The node at i, with all up to its end tag if it is a start tag."""
    if isinstance(nodes[i], str) and nodes[i].startswith("<"):
        depth = 0
        for k in range(i, len(nodes)):
            if isinstance(nodes[k], str) and nodes[k][1:] == nodes[i][1:] and nodes[k][0] in "<>":
                depth += 1 if nodes[k][0] == "<" else -1
                if depth == 0:
                    return nodes[i:k + 1]
    return nodes[i:i + 1]


def _merge(a: list, i: int, b: list, j: int):
    """One group for what begins at both places, at least one of them a group; how many nodes of each it takes."""
    units = [list(n[k][1]) if isinstance(n[k], tuple) else _unit(n, k) for n, k in ((a, i), (b, j))]
    kinds = {n[k][0] for n, k in ((a, i), (b, j)) if isinstance(n[k], tuple)}
    taken = [1 if isinstance(n[k], tuple) else len(u) for (n, k), u in zip(((a, i), (b, j)), units)]
    body = tuple(units[0] if units[0] == units[1] else align(*units))
    if len(body) == 1 and isinstance(body[0], tuple) and body[0][0] in kinds:
        body = body[0][1]
    node = ("?", (("+", body),)) if kinds == {"?", "+"} else (next(iter(kinds)), body)
    return node, *taken


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Places of the same fixed texts outside groups, once in both: the longest run that has one order in both."""
    once = [{n: k for k, n in enumerate(nodes) if isinstance(n, str) and n.startswith(FIXED)} for nodes in (a, b)]
    many = [Counter(n for n in nodes if isinstance(n, str)) for nodes in (a, b)]
    pairs = [(i, once[1][n]) for n, i in once[0].items() if many[0][n] == 1 == many[1][n]]
    ends: list[int] = []
    runs: list[tuple] = []
    for i, j in pairs:
        k = bisect_left(ends, j)
        ends[k:k + 1], runs[k:k + 1] = [j], [((i, j), runs[k - 1] if k else None)]
    out, run = [], runs[-1] if runs else None
    while run:
        out.append(run[0])
        run = run[1]
    return out[::-1]


def align(a: list, b: list) -> list:
    """The union-free expression of two: common nodes stay, what only one has becomes optional. Texts that both have are aligned first."""
    out, at_a, at_b = [], 0, 0
    for i, j in _anchors(a, b):
        first, last = 0, 1  # with the tags around the text
        while i - first > at_a and j - first > at_b and a[i - first - 1] == b[j - first - 1] and str(a[i - first - 1]).startswith("<"):
            first += 1
        while i + last < len(a) and j + last < len(b) and a[i + last] == b[j + last] and str(a[i + last]).startswith(">"):
            last += 1
        out += _between(a[at_a:i - first], b[at_b:j - first]) + a[i - first:i + last]
        at_a, at_b = i + last, j + last
    return repeats(out + _between(a[at_a:], b[at_b:]))


def _between(a: list, b: list) -> list:
    """The same node by node, by their keys."""
    places: list[dict] = []
    for nodes in (a, b):
        index = defaultdict(list)
        for k, node in enumerate(nodes):
            index[_key(node)].append(k)
        places.append(index)

    def following(side, key, start):
        found = places[side].get(key, ())
        k = bisect_left(found, start)
        return found[k] if k < len(found) else None

    def optional(nodes):
        return [n if isinstance(n, tuple) and n[0] == "?" else ("?", (n,)) for n in nodes] if len(nodes) == 1 else [("?", tuple(nodes))] if nodes else []

    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if _key(a[i]) == _key(b[j]):
            if a[i] == b[j]:
                out.append(a[i])
                i, j = i + 1, j + 1
            elif isinstance(a[i], str) and isinstance(b[j], str):  # different texts in one place
                out.append(_slot(a[i]))
                i, j = i + 1, j + 1
            else:
                node, more_i, more_j = _merge(a, i, b, j)
                out.append(node)
                i, j = i + more_i, j + more_j
            continue
        in_b, in_a = following(1, _key(a[i]), j), following(0, _key(b[j]), i)
        if in_b is None and in_a is None:
            out += optional([a[i]]) + optional([b[j]])
            i, j = i + 1, j + 1
        elif in_a is None or in_b is not None and in_b - j <= in_a - i:
            out += optional(b[j:in_b])
            j = in_b
        else:
            out += optional(a[i:in_a])
            i = in_a
    return out + optional(a[i:]) + optional(b[j:])


def written_out(nodes) -> str:
    """A wrapper as text, groups in brackets."""
    return " ".join(n if isinstance(n, str) else f"( {written_out(n[1])} ){n[0]}" for n in nodes)


def read_back(text: str) -> list:
    stack: list[list] = [[]]
    for word in text.split():
        if word == "(":
            stack.append([])
        elif word in (")?", ")+"):
            body = tuple(stack.pop())
            stack[-1].append((word[1], body))
        else:
            stack[-1].append(word)
    return stack[0]


def infer(streams: list[str]) -> str:
    """One wrapper for all streams or wrappers."""
    wrapper: list | None = None
    for s in sorted(streams, key=lambda s: (len(s), s)):
        nodes = repeats(read_back(s))
        wrapper = nodes if wrapper is None else align(wrapper, nodes)
    return written_out(wrapper or [])


def _inside(names: list[str]) -> str:
    """Whether a path leads through an article, through a main element, or neither."""
    if any(n.split(".")[0] == "article" for n in names):
        return "article"
    return "main" if any(n.split(".")[0] == "main" or n.endswith("role=main") for n in names) else ""


def content_slots(mass: dict[str, float]) -> list[str]:
    """The paths of one page that hold main text. `mass`: characters that pages of the host with this path have there on average."""
    for kind in ("article", "main"):
        chosen = sorted(p for p in mass if _inside(p.split(">")) == kind)
        if chosen:
            return chosen
    prefix: list[str] = []
    while True:
        below: Counter = Counter()
        here = 0.0
        for p, n in mass.items():
            names = p.split(">")
            if names[:len(prefix)] == prefix:
                here += n
                if len(names) > len(prefix) and names[len(prefix)].split(".")[0] in ("html", "body", "div", "section", "table", "tbody", "tr", "td", "center"):
                    below[names[len(prefix)]] += n
        best = min(below.items(), key=lambda x: (-x[1], x[0]), default=None)
        if not best or best[1] < 0.6 * here:
            break
        prefix.append(best[0])
    return sorted(p for p in mass if p.split(">")[:len(prefix)] == prefix)


def _rows(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))


def _observed(rows: DataFrame) -> DataFrame:
    """(host, kind, value, n, pages): distinct streams with their pages, and characters and pages at paths outside articles and main elements, added up in each batch."""
    def run(batches):
        for batch in batches:
            totals, pages, shapes = Counter(), Counter(), {}
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host, nodes, paths = host_of(url), [], set()
                for event in stream(page):
                    if event[0] == SLOT:
                        outside = not event[2] and not _inside(event[1].split(">"))
                        nodes.append(fixed_text(event[1], event[3]) if outside else SLOT + event[1])
                        if outside:
                            totals[host, "mass", event[1]] += len(event[3])
                            paths.add((host, "mass", event[1]))
                    else:
                        nodes.append(("<" if event[0] == "+" else ">") + event[1])
                pages.update(paths)
                # Pages of one shape are aligned at once, place by place.
                shape = host, tuple(map(_slot, nodes)) if paths else written_out(repeats(nodes))
                before, n = shapes.get(shape, (nodes, 0))
                shapes[shape] = [a if a == b else _slot(a) for a, b in zip(before, nodes)] if paths and before is not nodes else before, n + 1
            for (host, _), (nodes, n) in shapes.items():
                totals[host, "stream", written_out(repeats(nodes))] += n
            hosts, kinds, values = zip(*totals) if totals else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(list(totals.values()), pa.int64()),
                 pa.array([pages[key] for key in totals], pa.int64())], ["host", "kind", "value", "n", "pages"])

    return rows.select("url", "html").mapInArrow(run, "host string, kind string, value string, n long, pages long")


def wrappers(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, wrapper, pages, mass (mean characters at the paths outside articles and main elements)."""
    observed = _observed(_rows(df, id_col, url_col, html_col)).groupBy("host", "kind", "value")
    seen = written(observed.agg(F.sum("n").alias("n"), F.sum("pages").alias("pages")), "streams")

    def together(group: pa.Table) -> pa.Table:
        return pa.table({"host": group.column("host")[:1], "wrapper": [infer(group.column("value").to_pylist())]})

    parts = (seen.where("kind = 'stream'").select("host", "value", F.pmod(F.xxhash64("value"), F.lit(SALT)).alias("part"))
             .groupBy("host", "part").applyInArrow(together, "host string, wrapper string"))
    whole = parts.withColumnRenamed("wrapper", "value").groupBy("host").applyInArrow(together, "host string, wrapper string")
    mass = seen.where("kind = 'mass'").groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("value", F.col("n") / F.col("pages")))).alias("mass"))
    counted = seen.where("kind = 'stream'").groupBy("host").agg(F.sum("n").alias("pages"))
    return written(whole.join(counted, "host").join(mass, "host", "left"), "wrappers")


def template(wrapper: str) -> list[str]:
    """The texts that every page of a wrapper has, in their order: those in no optional or repeated group."""
    return [n for n in read_back(wrapper) if isinstance(n, str) and n.startswith(FIXED)]


def _matched(texts: list[tuple[str, str]], fixed: list[str]) -> set[int]:
    """Places of the template's texts among those of a page; none if the page does not have them all in their order."""
    found: set[int] = set()
    for i, (path, text) in enumerate(texts):
        if len(found) < len(fixed) and fixed[len(found)].endswith(SLOT + path) and fixed_text(path, text) == fixed[len(found)]:
            found.add(i)
    return found if len(found) == len(fixed) else set()


def page_text(page: str, mass: dict[str, float], fixed: list[str] = ()) -> str:
    """What the content slots of a page hold, blocks in page order. `mass` as for `content_slots`, of the page's host, `fixed` its template.

    Articles and main elements are whole by their marks. Elsewhere the wrapper tells template from slot; a page that has nothing
    but template keeps it, as its host shows no other page to tell them apart.
    """
    texts = [(e[1], e[3]) for e in stream(page) if e[0] == SLOT and not e[2]]
    content = set(content_slots({path: mass.get(path, 0.0) for path, _ in texts}))
    chosen = [i for i, (path, _) in enumerate(texts) if path in content]
    if fixed and chosen and not _inside(texts[chosen[0]][0].split(">")):
        outside = [(i, t) for i, t in enumerate(texts) if not _inside(t[0].split(">"))]
        common = {outside[k][0] for k in _matched([t for _, t in outside], fixed)}
        chosen = [i for i in chosen if i not in common] or chosen
    return "\n\n".join(texts[i][1] for i in chosen)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and the main text of every page."""
    # Only wrappers with fixed texts go on to the pages.
    decides = (F.col("pages") >= LEAST) & F.col("wrapper").rlike(f"(^| ){FIXED}")
    found = wrappers(df, id_col, url_col, html_col).select("host", "mass", F.when(decides, F.col("wrapper")).alias("wrapper"))
    rows = _rows(df, id_col, url_col, html_col)
    kind = rows.schema["page_id"].dataType.simpleString()

    def with_host(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(map(host_of, batch.column(1).to_pylist())), pa.string())], ["page_id", "url", "html", "host"])

    def run(batches):
        for batch in batches:
            for start, end in slices([len(h.as_buffer()) for h in batch.column(2)]):
                part = batch.slice(start, end - start)
                templates = {w: template(w or "") for w in part.column(4).unique().to_pylist()}
                texts = [page_text(h, dict(m or ()), templates[w]) for h, m, w in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    hosted = rows.mapInArrow(with_host, f"page_id {kind}, url string, html string, host string")
    return hosted.join(found, "host", "left").select("page_id", "url", "html", "mass", "wrapper").mapInArrow(run, f"page_id {kind}, url string, text string")


def report(extracted: DataFrame) -> DataFrame:
    return extracted.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
