"""Main-text extraction with a recurrent block labeller.

A page is cut into leaf blocks: stretches of text between block-level tags, each with its path of tags, classes and ids. A
block's input is the mean of learned vectors of its hashed path parts, the mean of learned vectors of its hashed words
and a few plain numbers. A bidirectional LSTM in numpy reads the page's blocks in both directions, so every
block is judged by the whole page, and labels it main text or not.

No page carries labels, so the labeller learns from pages that mark their article themselves (``article``, ``main``): a block is main
text if it lies in there and in none of the boilerplate parts below. To carry over to pages without such marks, each training page
is also shown with the marking tags renamed to plain ones, and with added sidebars, notices, adverts, forms and
reader comments, made of other training pages' sentences. Training takes the first ``MAX_FIT_PAGES`` distinct marked
pages by a hash of the page (a documented bound).

Scripts, styles, comments and the head hold no blocks. Character references are decoded, white space in a block becomes one
space, blocks are joined in page order by one space; nothing else is dropped or cut.

Tags end as in browsers: quoted attribute values of any length may hold '>'; a quote that never closes is a plain character.

Edge cases: null and empty html, and pages without text, give an empty text; unclosed or stray tags are closed or passed over as they
come; if no page marks an article, blocks outside the boilerplate parts are taken; repeated rows get equal texts;
very long pages are read as one sequence.
"""

from __future__ import annotations

import html as htmllib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import no_text, text_batches, without

MAX_FIT_PAGES = 200
PATH_BUCKETS, WORD_BUCKETS, WIDTH, HIDDEN = 512, 1024, 12, 16
NUMBERS = 6
ROUNDS, BATCH, RATE = 5, 16, 0.01
SIDE_BY_SIDE = 64

#: Elements that stay inside a block, elements without text, elements without an end tag (fixed values of HTML).
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr object "
                   "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom "
                   "menclose merror mspace mmultiscripts semantics svg g text tspan textpath desc path rect circle ellipse line polygon "
                   "polyline use defs symbol marker lineargradient radialgradient stop clippath mask pattern image".split())
RAW = frozenset("script style noscript template title textarea iframe select head".split())
TO_THE_END = frozenset("script style title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and words of classes or ids that mark an article, or boilerplate.
ARTICLE = frozenset("article main".split())
BOILERPLATE = frozenset("nav footer header aside form button menu dialog address".split())
BOILERPLATE_WORDS = frozenset("ad ads advert advertisement banner breadcrumb comment comments cookie footer header menu nav navigation "
                              "newsletter notice popup promo related share sidebar social sponsor subscribe widget".split())
PLAIN_NAMES = ("content", "post", "entry", "story", "body", "text", "page", "wrap", "")

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z])""", re.S)
_TAG_NAME = re.compile(r"[^\s/>]*+")
#: One attribute, or the space between two. A quote opens a value after "=" only, and only if it closes; else it is a plain character.
_ATTR = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)"""
_ONE_ATTR, _TAG_END = re.compile(_ATTR), re.compile(rf"{_ATTR}*+>")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Za-z]+")
_END = {t: re.compile(rf"</{t}\s*>|</{t}\Z", re.I) for t in RAW}


class Block:
    __slots__ = ("path", "text", "links")

    def __init__(self, path: tuple, text: str, links: float):
        self.path, self.text, self.links = path, text, links


def _shut(stack: list[tuple], tag: str) -> None:
    """Ends an open ``tag`` that a following block closes by itself."""
    k = len(stack) - 1
    while k >= 0 and stack[k][0] in INLINE:
        k -= 1
    if k >= 0 and stack[k][0] == tag:
        del stack[k:]


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """The end of the tag whose attributes start at ``at``. If quoted values hold every '>' up to the end of the page, it
    is the first '>'; ``dead`` keeps the places from where that is so, and each is walked only once."""
    if not dead and (m := _TAG_END.match(page, at)):
        return m.end()
    place, walked = at, []
    while place < len(page) and place not in dead:
        if page[place] == ">":
            return place + 1
        walked.append(place)
        place = _ONE_ATTR.match(page, place).end()
    dead.update(walked)
    return page.index(">", at) + 1


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks with their paths: a tuple of (tag, class and id words) from the outside in."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple] = []
    parts: list[str] = []
    linked = at = seek = 0
    last, dead = page.rfind(">"), set()

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(htmllib.unescape("".join(parts)).split())
            if text:
                out.append(Block(tuple(x for x in stack if x[0] not in INLINE), text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0
    while True:
        m = _TAG.search(page, max(at, seek))
        if m and m[3] and m.start() > last:     # no tag: nothing ends it
            seek = m.start() + 1
            continue
        if m is None or m.start() > at:
            piece = page[at:m.start() if m else None]
            parts.append(piece)
            if any(x[0] == "a" for x in stack):
                linked += len(piece)
        if m is None:
            break
        at = m.end()
        if m[1] is not None:
            parts.append(m[1])
        if not m[3]:
            continue
        name_end = _TAG_NAME.match(page, at).end()
        tag, at = page[m.start(3):name_end].lower(), _tag_end(page, name_end, dead)
        if m[2]:
            if tag not in INLINE:
                close()
            if any(x[0] == tag for x in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag == "br":
            parts.append(" ")
            continue
        attrs = page[name_end:at - 1]
        if tag in RAW and not attrs.rstrip().endswith("/"):
            close()
            end = _END[tag].search(page, at)
            at = end.end() if end else (len(page) if tag in TO_THE_END else at)
            continue
        if tag not in INLINE:
            close()
            _shut(stack, "p")
            if tag == "li":
                _shut(stack, "li")
        if tag not in VOID and not attrs.rstrip().endswith("/"):
            names = tuple(w.lower() for n in _NAMES.findall(attrs) for w in _PART.findall("".join(n))) if "=" in attrs else ()
            stack.append((tag, names))
    close()
    return out


def is_boilerplate(path: tuple) -> bool:
    return any(t in BOILERPLATE or not BOILERPLATE_WORDS.isdisjoint(names) for t, names in path)


def silver(path: tuple) -> int:
    return int(any(t in ARTICLE for t, _ in path) and not is_boilerplate(path))


def _inputs(blocks: list[Block]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    path, word, number = [], [], np.zeros((len(blocks), NUMBERS), np.float32)
    for i, b in enumerate(blocks):
        keys = [f"{t}" for t, _ in b.path] + [f".{n}" for _, names in b.path for n in names]
        keys += [f"^{b.path[-1][0]}"] if b.path else ["^"]
        path.append(np.array([zlib.crc32(k.encode()) % PATH_BUCKETS for k in keys]))
        words = b.text.lower().encode("utf-8", "replace").split()
        word.append(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORD_BUCKETS)
        n = len(words)
        number[i] = (np.log1p(n) / 6, b.links, b.text.count(",") / n, b.text.count(".") / n, b.text[-1] in ".!?", len(b.path) / 10)
    return path, word, number


def _bag(table: np.ndarray, bags: list[np.ndarray]) -> np.ndarray:
    size = np.array([len(b) for b in bags])
    rows = table[np.concatenate(bags)]
    return np.add.reduceat(rows, np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0) / size[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, b: np.ndarray, keep: bool):
    """x (T, pages, width) -> hidden states (T, pages, HIDDEN); a page's state holds still where its mask is 0."""
    t, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    out, tape = np.empty((t, n, HIDDEN), x.dtype), []
    base = x @ w[:x.shape[2]] + b
    for k in range(t):
        g = base[k] + h @ w[x.shape[2]:]
        i, f, o = (_sigmoid(g[:, j * HIDDEN:(j + 1) * HIDDEN]) for j in range(3))
        z = np.tanh(g[:, 3 * HIDDEN:])
        c2 = f * c + i * z
        tc = np.tanh(c2)
        m = mask[k][:, None]
        if keep:
            tape.append((h, c, i, f, o, z, tc, m))
        h, c = m * (o * tc) + (1 - m) * h, m * c2 + (1 - m) * c
        out[k] = h
    return out, tape


def _lstm_back(x: np.ndarray, w: np.ndarray, tape: list, dout: np.ndarray):
    t, n, width = x.shape
    dw, dx = np.zeros_like(w), np.zeros_like(x)
    db, dh, dc = np.zeros(4 * HIDDEN, x.dtype), np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    for k in range(t - 1, -1, -1):
        h, c, i, f, o, z, tc, m = tape[k]
        dh = dh + dout[k]
        a, e = m * dh, m * dc
        e = e + a * o * (1 - tc * tc)
        g = np.concatenate([e * z * i * (1 - i), e * c * f * (1 - f), a * tc * o * (1 - o), e * i * (1 - z * z)], axis=1)
        dw[:width] += x[k].T @ g
        dw[width:] += h.T @ g
        db += g.sum(0)
        back = g @ w.T
        dx[k] = back[:, :width]
        dh, dc = back[:, width:] + (1 - m) * dh, e * f + (1 - m) * dc
    return dw, db, dx


def new_model(seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    width = 2 * WIDTH + NUMBERS
    f = np.float32
    model = {"path": rng.normal(0, 0.3, (PATH_BUCKETS, WIDTH)).astype(f), "word": rng.normal(0, 0.3, (WORD_BUCKETS, WIDTH)).astype(f),
             "out": rng.normal(0, 0.3, 2 * HIDDEN + 1).astype(f)}
    for d in ("fore", "back"):
        model[d] = rng.normal(0, 1 / np.sqrt(width + HIDDEN), (width + HIDDEN, 4 * HIDDEN)).astype(f)
        model[d + "_b"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(f)
    return model


def _run(model: dict, pages: list[tuple], keep: bool = False):
    """Pages' inputs side by side: probabilities (T, pages), and what the backward pass needs."""
    size = np.array([len(p[2]) for p in pages])
    t = int(size.max())
    at = [(k, j) for j, n in enumerate(size) for k in range(n)]
    rows, cols = np.array([a[0] for a in at]), np.array([a[1] for a in at])
    path, word = [b for p in pages for b in p[0]], [b for p in pages for b in p[1]]
    x = np.zeros((t, len(pages), 2 * WIDTH + NUMBERS), np.float32)
    x[rows, cols] = np.concatenate([_bag(model["path"], path), _bag(model["word"], word), np.concatenate([p[2] for p in pages])], axis=1)
    mask = np.zeros((t, len(pages)), np.float32)
    mask[rows, cols] = 1
    fore, tape_f = _lstm(x, mask, model["fore"], model["fore_b"], keep)
    back, tape_b = _lstm(x[::-1], mask[::-1], model["back"], model["back_b"], keep)
    both = np.concatenate([fore, back[::-1]], axis=2)
    p = _sigmoid(both @ model["out"][:-1] + model["out"][-1])
    return p, (x, mask, tape_f, tape_b, both, rows, cols, path, word)


def _gradients(model: dict, pages: list[tuple], labels: list[np.ndarray]) -> dict:
    p, (x, mask, tape_f, tape_b, both, rows, cols, path, word) = _run(model, pages, True)
    y = np.zeros_like(p)
    y[rows, cols] = np.concatenate(labels)
    d = (p - y) * mask / len(rows)
    grad = {"out": np.append(np.tensordot(d, both, ((0, 1), (0, 1))), d.sum()).astype(np.float32)}
    dboth = d[:, :, None] * model["out"][:-1]
    grad["fore"], grad["fore_b"], dx = _lstm_back(x, model["fore"], tape_f, dboth[:, :, :HIDDEN])
    grad["back"], grad["back_b"], dxb = _lstm_back(x[::-1], model["back"], tape_b, dboth[::-1, :, HIDDEN:])
    dx = (dx + dxb[::-1])[rows, cols]
    for name, bags, part in (("path", path, dx[:, :WIDTH]), ("word", word, dx[:, WIDTH:2 * WIDTH])):
        size = np.array([len(b) for b in bags])
        grad[name] = np.zeros_like(model[name])
        np.add.at(grad[name], np.concatenate(bags), np.repeat(part / size[:, None], size, axis=0))
    return grad


def ruled(path: tuple) -> int:
    """The label of a block on pages that mark no article: not boilerplate by its tags and class words."""
    return int(not is_boilerplate(path))


def _sentences(blocks: list[Block], label=silver) -> list[str]:
    return [b.text for b in blocks if label(b.path)]


def _varied(blocks: list[Block], rng: np.random.Generator, texts: list[str], label=silver) -> tuple[list[Block], np.ndarray]:
    """A page in another shape: marking tags renamed, boilerplate parts added; labels stay those of the original."""
    y = [label(b.path) for b in blocks]
    plain = rng.random() < 0.7
    name = str(rng.choice(PLAIN_NAMES))
    alias = {t: ("div", (str(rng.choice(sorted(BOILERPLATE_WORDS))),) if rng.random() < 0.7 else ()) for t in BOILERPLATE}
    alias |= {t: ("div", (name,) if name else ()) for t in ARTICLE}
    out = [Block(tuple((alias.get(t, (t, n))[0], (*n, *alias.get(t, (t, ()))[1])) for t, n in b.path) if plain else b.path, b.text, b.links)
           for b in blocks]
    body = [i for i, v in enumerate(y) if v]
    outer = blocks[0].path[:2]

    def pick(words: int) -> str:
        return " ".join(texts[int(rng.integers(len(texts)))].split()[:words])
    extra: list[tuple[int, list[Block]]] = []
    for kind in ("comments", "sidebar", "notice", "ad", "form"):
        if rng.random() < 0.5 or not body or not texts:
            continue
        tag, cls = ("div", (kind if kind != "comments" else str(rng.choice(["comments", "comment"])),))
        if kind == "sidebar" and rng.random() < 0.5:
            tag, cls = "aside", ()
        if kind == "form":
            tag, cls = "form", ()
        inside = out[body[0]].path[:-1] if kind == "ad" and rng.random() < 0.5 else outer
        parts = [Block((*inside, (tag, cls), (str(rng.choice(["p", "div", "li"])), ())), pick(int(rng.integers(3, 40)) if kind == "comments" else int(rng.integers(2, 12))),
                       float(rng.random() < 0.3)) for _ in range(int(rng.integers(1, 6)))]
        place = body[-1] + 1 if kind == "comments" else int(rng.choice([0, body[-1] + 1, int(rng.choice(body)) if inside is not outer else 0]))
        extra.append((place, parts))
    for place, parts in sorted(extra, key=lambda e: -e[0]):
        out[place:place] = parts
        y[place:place] = [0] * len(parts)
    return out, np.array(y, np.float32)


def fit(pages: list[str], seed: int = 7) -> dict | None:
    """A labeller from pages that mark their article; if none does, from what the rule on tags and class words says of their blocks.
    None without a block to learn from."""
    rng = np.random.default_rng(seed)
    every = [b for b in map(blocks_of, pages) if b]
    label = silver if any(silver(x.path) for b in every for x in b) else ruled
    cut = [b for b in every if any(label(x.path) for x in b)]
    if not cut:
        return None
    texts = [t for b in cut for t in _sentences(b, label)][:4000]
    shown = []
    for b in cut:
        shown.append((b, np.array([label(x.path) for x in b], np.float32)))
        shown += [_varied(b, rng, texts, label) for _ in range(2)]
    data = [(_inputs(b), y) for b, y in shown]
    model = new_model(seed)
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    step = 0
    for _ in range(ROUNDS):
        order = sorted(rng.permutation(len(data)).tolist(), key=lambda i: len(data[i][1]) // 8)
        groups = [order[i:i + BATCH] for i in range(0, len(order), BATCH)]
        for g in rng.permutation(len(groups)):
            part = [data[i] for i in groups[g]]
            step += 1
            for k, d in _gradients(model, [p[0] for p in part], [p[1] for p in part]).items():
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                model[k] = model[k] - RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)
    return model


def label_blocks(model: dict | None, pages: list[list[Block]]) -> list[np.ndarray]:
    """Whether each block of each page is main text."""
    out = [np.array([not is_boilerplate(b.path) for b in p], bool) for p in pages]
    if model is None:
        return out
    todo = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    for at in range(0, len(todo), SIDE_BY_SIDE):
        part = todo[at:at + SIDE_BY_SIDE]
        p, _ = _run(model, [_inputs(pages[i]) for i in part])
        for j, i in enumerate(part):
            out[i] = p[:len(pages[i]), j] >= 0.5
    return out


def main_texts(model: dict | None, pages: list[str | None]) -> list[str]:
    cut = [blocks_of(p) for p in pages]
    return [" ".join(b.text for b, k in zip(bs, keep) if k) for bs, keep in zip(cut, label_blocks(model, cut))]


def is_marked(page: str) -> bool:
    """Whether ``fit`` can learn from the page."""
    return any(silver(b.path) for b in blocks_of(page))


def _marked_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = pa.array([is_marked(h) for h in b.column("h").to_pylist()], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("k").filter(found)], names=["k"])


def training_pages(df: DataFrame, html: str = "html", max_pages: int = MAX_FIT_PAGES) -> list[str]:
    """Of the distinct pages that mark an article, the ``max_pages`` smallest by a hash of the page; of all distinct pages, if none does.
    Slices of the hash are read, eight times wider each time, until one holds enough marked pages or is the whole table."""
    text_batches(df.sparkSession)
    spread = 1 << 40
    every = df.select(no_text(html).alias("h")).where(F.octet_length("h") > 0).select("h", F.pmod(F.xxhash64("h"), F.lit(spread)).alias("k"))
    rows = (every.where(F.col("h").rlike("(?i)<(" + "|".join(sorted(ARTICLE)) + ")")))
    n = rows.count()
    cut = min(spread, 2 * max_pages * spread // max(1, n))
    while True:
        marked = rows.where(F.col("k") < cut).select("h", "k").mapInArrow(_marked_keys, "k long").distinct()
        keys = [r["k"] for r in marked.orderBy("k").limit(max_pages).collect()]
        if len(keys) >= max_pages or cut >= spread:
            break
        cut = min(spread, 8 * cut)
    if not keys:
        rows = every
        keys = [r["k"] for r in every.select("k").distinct().orderBy("k").limit(max_pages).collect()]
    return sorted(r["h"] for r in rows.where(F.col("k").isin(keys)).groupBy("k").agg(F.first("h").alias("h")).collect()) if keys else []


def train(df: DataFrame, html: str = "html", max_pages: int = MAX_FIT_PAGES) -> dict | None:
    """Fits the labeller on at most ``max_pages`` marked pages, whole ones of any length (or as many others, if none
    is marked); None if no page has a block."""
    return fit(training_pages(df, html, max_pages))


def extract(df: DataFrame, model: dict | None, html: str = "html", out: str = "text") -> DataFrame:
    """Replaces ``html`` by the main text; keeps the other columns, but a given column named as the result is replaced."""
    spark = df.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rest = without(df, html, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = main_texts(shared.value, b.column(html).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(texts, pa.string())], names=[*rest, out])
    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.StringType())]))
