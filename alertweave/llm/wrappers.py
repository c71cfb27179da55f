"""Main text of web pages by wrappers that are inferred for each host.

1. Pages are read as streams of tags and texts. Streams of one host are aligned, one after the other, into a wrapper, a
   regular expression without unions: tags that all have stay; a mismatch becomes an optional group, or, where the same
   group comes again, a repeated one; a text that differs becomes a slot. Each task keeps one wrapper for each host
   it meets; these are aligned with each other host by host, so a host with most of the pages costs one small wrapper
   a task.
2. A wrapper also keeps, for each path, the blocks of text that every page with that path has. Where ``SUPPORT`` pages
   with different texts agree on a block, it is a constant of the host, wherever it stands; all others are slots.
3. Every page is read again, with its host's wrapper joined by host. Its layout is its own: the article or main part, else
   groups with a content-like class, else the group that holds most of the host's text in slots, else all that its tags
   do not rule out. Menus, headers, sidebars, notices, adverts, forms and reader comments are left out, and then the
   host's constants, unless nothing but constants is there (copies of one page). Class and id words never rule out html, body or a
   main group, nor an article where the page has no other.

Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by an
empty line. A null or broken page gives what can be read of it; a page without a host is a host of its own kind.
Repeated rows are read each. Other columns stay out of the way.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave.llm.common import over_texts, read, slices, small_batches

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|<[a-zA-Z/][^>]*\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Tags that end an open paragraph; what a new item of the same kind ends.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
DROPPED = frozenset("head title nav footer aside form button dialog menu object audio video canvas".split())
NOISE = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menu\w*|(?:site|page|top)?header|masthead|(?:site|page)?footer|sidebar\w*|aside|ads?|advert\w*|banner\w*|promo\w*|sponsor\w*"
    r"|cookie\w*|consent|gdpr|notice\w*|notification\w*|alert\w*|popup|modal|overlay|newsletter|subscri\w*|signup|login|share\w*|sharing"
    r"|social|related|recommend\w*|breadcrumb\w*|comments?|commentlist|respond|repl(?:y|ies)|discussion|disqus|search\w*|pagination|pager|toolbar"
    r"|widget\w*|skip\w*|copyright|legal|disclaimer|paywall|teaser\w*)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
MAIN = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main|content)(?:[\s_-]?(?:body|content|text))?(?:$|[\s_-])", re.I)
#: Blocks of text rather than groups of blocks.
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 td th dt dd pre blockquote".split())
#: What stands for a text in the stream.
TEXT = "#"
#: Pages with different texts that must agree on a block before it is a constant.
SUPPORT = 3


def _key(tag: str, attributes: str) -> str:
    """A tag with its class, id and role; numbers in them tell rows apart and not groups."""
    if "=" not in attributes:
        return tag
    found = {k.lower(): re.sub(r"\d+", "", v.strip("\"'")).strip() for k, v in ATTRIBUTE.findall(attributes)}
    return tag + "".join(f"{mark}{' '.join(found[k].split())}" for k, mark in (("class", "."), ("id", "!"), ("role", "~")) if found.get(k))


def stream(page: str) -> Iterator[tuple[str, tuple[str, ...]]]:
    """Texts of a page with the keys of the open blocks around them; an empty text where a block begins or ends."""
    stack: list[str] = []
    names: list[str] = []
    at = 0

    def close(upto: int) -> None:
        del stack[upto:], names[upto:]

    for m in MARKUP.finditer(page):
        if m.start() > at:
            yield page[at : m.start()], tuple(stack)
        at = m.end()
        tag = m.group(3)
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            yield " ", tuple(stack)
        elif tag in INLINE:
            continue
        elif m.group(2):
            if tag in names:
                close(len(names) - 1 - names[::-1].index(tag))
                yield "", tuple(stack)
        else:
            if tag in CLOSES_P and names and names[-1] == "p":
                close(len(names) - 1)
            for i in range(len(names) - 1, -1, -1):
                if names[i] in SIBLINGS.get(tag, ()):
                    close(i)
                    break
                if names[i] in ("ul", "ol", "dl", "table", "div"):
                    break
            if tag in VOID and tag != "hr":
                continue
            if tag not in VOID:
                stack.append(_key(tag, m.group(4)))
                names.append(tag)
            yield "", tuple(stack)
    if at < len(page):
        yield page[at:], tuple(stack)


# A wrapper is a list of groups [key, optional, repeated, inner groups]; a text is a group with the key TEXT.


def _mark(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")


def _block(pieces: list[str]) -> str:
    return " ".join(entities.unescape("".join(pieces)).split())


def _page_tree(page: str) -> tuple[list, dict[str, str], Counter, dict[str, tuple[set[int], list[int]]]]:
    """The stream of a page as groups; by path its texts, their length, and marks of its blocks with the mark of the page."""
    root: list = []
    open_groups: list[tuple[str, list]] = []
    texts: dict[str, str] = {}
    lengths: Counter = Counter()
    marks: dict[tuple[str, ...], set[int]] = {}
    ruled_out: dict[tuple[str, ...], bool] = {}
    held: list[str] = []
    around: tuple[str, ...] = ()

    def end() -> None:
        block = _block(held)
        held.clear()
        if block:
            marks.setdefault(around, set()).add(_mark(block))

    for text, stack in stream(page):
        if not text:
            end()
        else:
            if stack not in ruled_out:
                ruled_out[stack] = any(_noise(k) for k in stack)
            if not ruled_out[stack] or any(_main(k) for k in stack):
                held.append(text)
                around = stack
        same = 0
        while same < min(len(stack), len(open_groups)) and stack[same] == open_groups[same][0]:
            same += 1
        # A block that begins anew has the keys of the one before it, and ends it all the same.
        if not text and len(open_groups) == len(stack) == same and same:
            same -= 1
        del open_groups[same:]
        for key in stack[same:]:
            inner: list = []
            (open_groups[-1][1] if open_groups else root).append([key, False, False, inner])
            open_groups.append((key, inner))
        if text.strip():
            where = open_groups[-1][1] if open_groups else root
            if not where or where[-1][0] != TEXT:
                where.append([TEXT, False, False, []])
            path = "/".join(stack)
            text = " ".join(text.split())
            lengths[path] += len(text)
            if texts.setdefault(path, text) != text:
                texts[path] = None
    end()
    whole = _mark(" ".join(str(m) for m in sorted(set().union(*(m for k, m in marks.items() if not ruled_out[k])))))
    return fold(root), texts, lengths, {"/".join(k): (m, [whole]) for k, m in marks.items()}


def fold(groups: list) -> list:
    """Join groups that come again right after one another into one repeated group."""
    out: list = []
    for key, optional, repeated, inner in groups:
        inner = fold(inner)
        if out and out[-1][0] == key:
            last = out[-1]
            out[-1] = [key, last[1] and optional, True, align(last[3], inner)]
        else:
            out.append([key, optional, repeated, inner])
    return out


def align(one: list, two: list) -> list:
    """The wrapper of two sequences of groups: what only one of them has becomes optional."""
    if one == two:
        return one
    n, m = len(one), len(two)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if one[i][0] == two[j][0] else max(best[i + 1][j], best[i][j + 1])
    out: list = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and one[i][0] == two[j][0]:
            a, b = one[i], two[j]
            out.append([a[0], a[1] or b[1], a[2] or b[2], align(a[3], b[3])])
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([one[i][0], True, one[i][2], one[i][3]])
            i += 1
        else:
            out.append([two[j][0], True, two[j][2], two[j][3]])
            j += 1
    return fold(out) if len(out) > max(n, m) else out


class Wrapper:
    """Groups of a host's pages, the text that all pages have at a path (None for a slot), and text lengths by path.

    ``marks`` holds for each path the blocks that all pages with it have, and the least ``SUPPORT`` marks of such pages.
    """

    def __init__(self, groups: list | None = None, texts: dict | None = None, lengths: dict | None = None, marks: dict | None = None):
        self.groups, self.texts, self.lengths = groups, texts or {}, Counter(lengths or {})
        self.marks = {path: (set(blocks), pages) for path, (blocks, pages) in (marks or {}).items()}
        self.seen: set[str] = set()

    def add(self, groups: list, texts: dict, lengths: dict, marks: dict) -> None:
        mark = json.dumps(groups)
        if mark not in self.seen:
            self.seen.add(mark)
            self.groups = groups if self.groups is None else align(self.groups, groups)
        for path, text in texts.items():
            if self.texts.setdefault(path, text) != text:
                self.texts[path] = None
        self.lengths.update(lengths)
        for path, (blocks, pages) in marks.items():
            if path in self.marks:
                all_have, known = self.marks[path]
                self.marks[path] = (all_have & blocks, sorted({*known, *pages})[:SUPPORT])
            else:
                self.marks[path] = (set(blocks), pages)

    def dump(self, whole: bool = False) -> str:
        """As text; of a whole host, without marks that are no constants."""
        marks = {p: (sorted(b), n) for p, (b, n) in self.marks.items() if not whole or b and len(n) == SUPPORT}
        return json.dumps([self.groups, self.texts, self.lengths, marks])

    @classmethod
    def load(cls, text: str) -> Wrapper:
        return cls(*json.loads(text))


@functools.lru_cache(maxsize=65536)
def _noise(key: str) -> bool:
    """Whether a group is none of the article, by its tag, class, id or role."""
    tag, *marks = re.split(r"[.!~]", key)
    return _ruled_out(key) or tag not in ("html", "body") and any(NOISE.search(m) for m in marks)


@functools.lru_cache(maxsize=65536)
def _ruled_out(key: str) -> bool:
    """Whether its tag or role alone says so."""
    return re.split(r"[.!~]", key)[0] in DROPPED or key.partition("~")[2] in ROLES


@functools.lru_cache(maxsize=65536)
def _main(key: str) -> bool:
    tag = re.split(r"[.!~]", key)[0]
    return tag in ("article", "main") or key.endswith("~main")


@functools.lru_cache(maxsize=65536)
def _like_main(key: str) -> bool:
    tag, *marks = re.split(r"[.!~]", key)
    return tag not in ("html", "body") and any(MAIN.search(m) for m in marks)


@functools.lru_cache(maxsize=512)
def rules_of(wrapper: str | None) -> tuple[str | None, dict[str, set[int]]]:
    """The path of the group that holds a host's text in slots, if there is one, and its constants by path."""
    if not wrapper:
        return None, {}
    w = Wrapper.load(wrapper)
    paths: list[tuple[str, ...]] = []

    def walk(groups: list, above: tuple[str, ...]) -> None:
        for key, _, _, inner in groups:
            if key != TEXT:
                paths.append((*above, key))
                walk(inner, (*above, key))

    walk(w.groups or [], ())
    clean = [p for p in paths if not any(_noise(k) for k in p)]
    # The smallest group that holds nine tenths of the text that changes from page to page.
    slots = {p: n for p, n in w.lengths.items() if w.texts.get(p) is None and not any(_noise(k) for k in p.split("/"))}
    total, choice = sum(slots.values()), ""
    for p in sorted(("/".join(p) for p in clean if re.split(r"[.!~]", p[-1])[0] not in LEAVES), key=lambda x: (x.count("/"), x)):
        inside = sum(n for q, n in slots.items() if q == p or q.startswith(p + "/"))
        if p.startswith(choice) and total and inside >= 0.9 * total:
            choice = p
    return choice or None, {p: b for p, (b, pages) in w.marks.items() if len(pages) >= SUPPORT}


def _in_main(stack: tuple[str, ...], above_counts: bool = True, main_counts: bool = True) -> bool:
    """Whether a text lies in a main group; class and id words of what is above it, or of main groups, may be told not to count."""
    first = next((i for i, k in enumerate(stack) if _main(k)), None)
    if first is None or any(k.startswith("header") for k in stack[:first]):
        return False
    if any(_noise(k) if above_counts else _ruled_out(k) and not k.startswith("form") for k in stack[:first]):
        return False
    # A header in the article holds its title; the page's own stands outside.
    return not any(_noise(k) if main_counts or not _main(k) else _ruled_out(k) for k in stack[first:] if not k.startswith("header"))


Blocks = list[tuple[tuple[str, ...], str]]


def _content(blocks: Blocks, choice: str | None) -> Blocks:
    """Blocks of the content groups of a page, by the first layout of which it has a group."""

    def those(test) -> Blocks:
        found = {stack: test(stack) for stack in {s for s, _ in blocks}}
        return [b for b in blocks if found[b[0]]]

    def length(some: Blocks) -> int:
        return sum(len(text) for _, text in some)

    def clean(stack: tuple[str, ...]) -> bool:
        return not any(_noise(k) or k.startswith("header") for k in stack)

    def under(stack: tuple[str, ...]) -> bool:
        path = "/".join(stack)
        return path == choice or path.startswith(f"{choice}/")

    def article(stack: tuple[str, ...]) -> bool:
        return any(re.match(r"article\b", k) for k in stack)

    main, loose = those(_in_main), those(lambda s: _in_main(s, main_counts=False))
    if main and (any(article(s) for s, _ in main) or length(loose) <= 2 * length(main)):
        return main
    return (
        (loose if main else [])
        or those(lambda s: clean(s) and any(_like_main(k) for k in s))
        or loose
        or (those(lambda s: clean(s) and under(s)) if choice else [])
        or those(lambda s: _in_main(s, False, False))
        or those(clean)
    )


def main_text(page: str | None, wrapper: str | None) -> str:
    """Blocks of the article of a page, joined by empty lines."""
    choice, constants = rules_of(wrapper)
    blocks: Blocks = []
    held: list[str] = []
    around: tuple[str, ...] = ()
    for text, stack in stream(page or ""):
        if text:
            held.append(text)
            around = stack
        elif held:
            blocks.append((around, _block(held)))
            held.clear()
    if held:
        blocks.append((around, _block(held)))
    found = _content([b for b in blocks if b[1]], choice)
    nothing: set[int] = set()
    slots = [text for stack, text in found if constants and _mark(text) not in constants.get("/".join(stack), nothing)]
    return "\n\n".join(slots or [text for _, text in found])


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper, one row for each host."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(known), pa.string()), pa.array([w.dump() for w in known.values()], pa.string())], names=["host", "wrapper"]
            )
            known.clear()
            return out

        for batch in batches:
            for part in slices(batch, "html"):
                for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    if page:
                        known.setdefault(host, Wrapper()).add(*_page_tree(page))
                if len(known) > 2000:
                    yield flush()
        if known:
            yield flush()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        whole = Wrapper()
        for text in sorted(rows["wrapper"]):
            w = Wrapper.load(text)
            whole.add(w.groups, w.texts, w.lengths, w.marks)
        return pd.DataFrame({"host": rows["host"].iloc[:1], "wrapper": [whole.dump(whole=True)]})

    found = pages.select("host", "html").mapInArrow(run, "host string, wrapper string")
    return found.groupBy("host").applyInPandas(merge, "host string, wrapper string")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    slim = pages.select("page_id", "url", "html", host.alias("host"))
    joined = slim.join(wrappers(slim), "host", "left").select("page_id", "url", "html", "wrapper")

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(part.column("html").to_pylist(), part.column("wrapper").to_pylist(), strict=True)
        texts = [main_text(page, wrapper) for page, wrapper in rows]
        arrays = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    return over_texts(joined, step, "page_id long, url string, text string, n_chars long", column="html")


def op2_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages"))
