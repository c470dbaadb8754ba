"""Edit-aware token counts: a kept tree of pre-token counts per document, of which an edit re-encodes only what it touches.

A text is cut into pre-tokens by the tokenizer's pattern; no token crosses two of them. ``write_trees`` gives each document's tree as a row to keep: the lengths and token counts of
its pre-tokens, in leaves of about ``LEAF``, with every leaf's sums. ``apply_edits`` takes such rows with edits (start, removed, inserted: characters replaced, one after
the other) and returns them renewed, and ``update_trees`` joins a table of edits to a table of trees, of which documents without edits never reach Python.

In a worker the leaves hang in a balanced tree of sums (characters, pre-tokens, tokens). The pattern looks at most two characters past a pre-token and never back, so
pre-tokens that end at least two characters before the edit stay; from the next one on the new text is cut again until a cut falls on an old one behind the edit, after which all
stay again. The tree is split there, and the leaves between, the only ones whose text is looked at and encoded, are replaced: a splice costs the touched leaves and the logarithm
of their number.

Defined cases: a null text is empty, and an empty text has no pre-token and count 0. An edit out of range is clipped to the text; a null start or number is 0, a null insertion
empty. Null or empty edits leave a document as it is. Repeated rows are documents of their own, and each gets its doc_id's edits, null doc_ids too; other columns are ignored; an
empty table gives an empty result. A text of any length is kept whole in one task, with its tree: a few times its own size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foldspark.llm.shared import lean
from foldspark.llm.tokens import _byte_letters

CACHE = 400_000
LONGEST = 64
#: Characters that the pattern may look at past a pre-token.
AHEAD = 2
#: Pre-tokens of a leaf.
LEAF = 128
#: Rows that a worker holds at once, and characters of text.
ROWS, STEP = 512, 1 << 22

EDITS = "array<struct<start:bigint,removed:bigint,inserted:string>>"
TREES = (
    "doc_id bigint, text string, n_pretokens bigint, n_tokens bigint, lengths binary, counts binary, leaves array<int>, leaf_chars array<bigint>, leaf_tokens array<bigint>"
)
_TREE_NAMES = [x.split()[0] for x in TREES.split(", ")]
_TREE_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
_MORE = "n_tokens_before bigint, n_pretokens_before bigint, pretokens_encoded bigint, chars_encoded bigint"


class Node:
    """A leaf (lengths and counts of pre-tokens and their text's place in ``source``) or a pair of subtrees; with sums. Never changed once made."""

    __slots__ = ("left", "right", "height", "parts", "chars", "tokens", "source", "at", "lengths", "counts")

    def __init__(self, left: Node, right: Node):
        self.left, self.right, self.height = left, right, 1 + max(left.height, right.height)
        self.parts, self.chars, self.tokens = left.parts + right.parts, left.chars + right.chars, left.tokens + right.tokens

    @classmethod
    def leaf(cls, source: str, at: int, lengths: Sequence[int], counts: Sequence[int], chars: int | None = None, tokens: int | None = None) -> Node:
        out = cls.__new__(cls)
        out.left = out.right = None
        out.height, out.source, out.at, out.lengths, out.counts = 0, source, at, lengths, counts
        out.parts, out.chars, out.tokens = len(lengths), sum(lengths) if chars is None else chars, sum(counts) if tokens is None else tokens
        return out

    @property
    def text(self) -> str:
        return self.source[self.at : self.at + self.chars]


def join(a: Node | None, b: Node | None) -> Node | None:
    """Both in order; the heights of a node's subtrees differ by one at most."""
    if a is None or b is None:
        return a or b
    if a.height > b.height + 1:
        return _even(a.left, join(a.right, b))
    if b.height > a.height + 1:
        return _even(join(a, b.left), b.right)
    return Node(a, b)


def _even(a: Node, b: Node) -> Node:
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return Node(a.left, Node(a.right, b))
        return Node(Node(a.left, a.right.left), Node(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return Node(Node(a, b.left), b.right)
        return Node(Node(a, b.left.left), Node(b.left.right, b.right))
    return Node(a, b)


def split(node: Node | None, k: int) -> tuple[Node | None, Node | None]:
    """The first ``k`` pre-tokens and the rest."""
    if node is None or k <= 0:
        return None, node
    if k >= node.parts:
        return node, None
    if node.left is None:
        first = Node.leaf(node.source, node.at, node.lengths[:k], node.counts[:k])
        return first, Node.leaf(node.source, node.at + first.chars, node.lengths[k:], node.counts[k:], node.chars - first.chars, node.tokens - first.tokens)
    if k <= node.left.parts:
        a, b = split(node.left, k)
        return a, join(b, node.right)
    a, b = split(node.right, k - node.left.parts)
    return join(node.left, a), b


def ended(node: Node | None, chars: int) -> int:
    """Pre-tokens that end within the first ``chars`` characters."""
    out = 0
    while node is not None and node.left is not None:
        if chars >= node.left.chars:
            out, chars, node = out + node.left.parts, chars - node.left.chars, node.right
        else:
            node = node.left
    for n in node.lengths if node is not None else ():
        chars -= n
        if chars < 0:
            break
        out += 1
    return out


def leaves(node: Node | None) -> Iterator[Node]:
    todo = [node] if node is not None else []
    while todo:
        x = todo.pop()
        if x.left is None:
            yield x
        else:
            todo += (x.right, x.left)


def grown(parts: Sequence[Node]) -> Node | None:
    """A balanced tree over leaves."""
    if len(parts) < 2:
        return parts[0] if parts else None
    half = len(parts) // 2
    return Node(grown(parts[:half]), grown(parts[half:]))


def _cut(source: str, lengths: list[int], counts: list[int]) -> list[Node]:
    out, at = [], 0
    for lo in range(0, len(lengths), LEAF):
        out.append(Node.leaf(source, at, lengths[lo : lo + LEAF], counts[lo : lo + LEAF]))
        at += out[-1].chars
    return out


class Counter:
    """Token counts of pre-tokens, with a bounded cache."""

    def __init__(self, path: str, pattern: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.cut = regex.compile(pattern)
        self.letters = _byte_letters()
        self.cache: dict[str, int] = {}

    def count(self, part: str) -> int:
        n = self.cache.get(part)
        if n is None:
            n = len(self.model.tokenize(part.encode().decode("latin-1").translate(self.letters)))
            if len(self.cache) >= CACHE:
                self.cache.clear()
            if len(part) <= LONGEST:
                self.cache[part] = n
        return n


def _packed(values: Sequence[int]) -> bytes:
    """Little-endian integers of one, two or four bytes, as the greatest needs."""
    return np.array(values, "<u1" if (most := max(values, default=0)) < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _unpacked(data: bytes, n: int) -> list[int]:
    return np.frombuffer(data, f"<u{len(data) // n}").tolist() if n else []


class Document:
    """A text's tree."""

    def __init__(self, text: str, counter: Counter, root: Node | None = None):
        self.counter = counter
        if root is None and text:
            parts = counter.cut.findall(text)
            root = grown(_cut(text, list(map(len, parts)), list(map(counter.count, parts))))
        self.root = root
        #: Pre-tokens and characters encoded again by edits so far.
        self.again, self.again_chars = 0, 0

    @property
    def n_tokens(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def n_pretokens(self) -> int:
        return self.root.parts if self.root else 0

    @property
    def n_chars(self) -> int:
        return self.root.chars if self.root else 0

    @property
    def text(self) -> str:
        return "".join([x.text for x in leaves(self.root)])

    def edit(self, start: int, removed: int, inserted: str) -> None:
        start = min(max(start, 0), self.n_chars)
        removed = min(max(removed, 0), self.n_chars - start)
        left, rest = split(self.root, ended(self.root, start - AHEAD))
        at = left.chars if left else 0
        start, stop, shift = start - at, start - at + removed, len(inserted) - removed
        need = stop + LONGEST
        while True:
            old, ends, size, here = [], [], 0, 0
            for x in leaves(rest):
                old.append(x.text)
                for n in x.lengths:
                    here += n
                    ends.append(here)
                size += x.chars
                if size >= need:
                    break
            whole = size == (rest.chars if rest else 0)
            near = "".join(old)
            near = near[:start] + inserted + near[stop:]
            place = {e: i for i, e in enumerate(ends, 1)}
            cuts, used = [], None
            for m in self.counter.cut.finditer(near):
                end = m.end()
                if not whole and end > len(near) - AHEAD:
                    break  # what follows might change this cut
                cuts.append(end)
                if end - shift >= stop and end >= start + len(inserted) and end - shift in place:
                    used = place[end - shift]
                    break
            else:
                if whole:
                    used = rest.parts if rest else 0
            if used is not None:
                break
            need = 2 * size
        parts = [near[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        middle = grown(_cut(near, list(map(len, parts)), list(map(self.counter.count, parts))))
        self.root = join(join(left, middle), split(rest, used)[1])
        self.again += len(parts)
        self.again_chars += cuts[-1] if cuts else 0

    def row(self) -> tuple:
        """The tree's columns, from ``text`` on; neighbouring leaves that fit one are made one."""
        lengths, counts, own, chars, tokens = [], [], [], [], []
        for x in leaves(self.root):
            lengths += x.lengths
            counts += x.counts
            if own and own[-1] + x.parts <= LEAF:
                own[-1], chars[-1], tokens[-1] = own[-1] + x.parts, chars[-1] + x.chars, tokens[-1] + x.tokens
            else:
                own.append(x.parts)
                chars.append(x.chars)
                tokens.append(x.tokens)
        return self.text, len(lengths), sum(tokens), _packed(lengths), _packed(counts), own, chars, tokens

    @classmethod
    def kept(cls, counter: Counter, text: str, n: int, lengths: bytes, counts: bytes, own: list[int], chars: list[int], tokens: list[int]) -> Document:
        """From a row: nothing is cut or encoded."""
        parts, lengths_, counts_, lo, at = [], _unpacked(lengths, n), _unpacked(counts, n), 0, 0
        for k, c, t in zip(own, chars, tokens, strict=True):
            parts.append(Node.leaf(text, at, lengths_[lo : lo + k], counts_[lo : lo + k], c, t))
            lo, at = lo + k, at + c
        return cls("", counter, grown(parts))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``ROWS`` rows with about ``STEP`` characters of text."""
    size = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)])
    lo = 0
    while lo < len(batch):
        hi = min(lo + ROWS, max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + STEP, "right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def write_trees(docs: DataFrame, *, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A tree for every row of ``docs``, as ``TREES`` says. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer, pattern)
        for batch in batches:
            for part in _slices(batch, 1):
                rows = [(d, *Document(t or "", counter).row()) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _TREE_TYPES, strict=True)], _TREE_NAMES)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), TREES)


def apply_edits(trees: DataFrame, *, tokenizer: str, pattern: str) -> DataFrame:
    """``trees`` (``TREES`` and edits, as ``EDITS`` says) after their edits, with the counts before and what was encoded again. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer, pattern)
        for batch in batches:
            for part in _slices(batch, 1):
                rows = []
                for doc_id, text, n, before, *tree, edits in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    doc = Document.kept(counter, text, n, *tree)
                    for e in edits or ():
                        if e is not None:
                            doc.edit(e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
                    rows.append((doc_id, *doc.row(), before, n, doc.again, doc.again_chars))
                names = [*_TREE_NAMES, *(x.split()[0] for x in _MORE.split(", "))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [*_TREE_TYPES, *[pa.int64()] * 4], strict=True)], names)

    return trees.select(*_TREE_NAMES, F.col("edits").cast(EDITS)).mapInArrow(lean(run), f"{TREES}, {_MORE}")


def update_trees(trees: DataFrame, edits: DataFrame, *, tokenizer: str, pattern: str) -> DataFrame:
    """``trees`` after ``edits`` (doc_id, edits; one row a doc_id). Only documents with edits are unpacked; the others pass with what they were and nothing encoded."""
    own = edits.select(F.col("doc_id").cast("bigint").alias("_id"), "edits").where(F.size("edits") > 0)
    both = trees.select(*_TREE_NAMES).join(own, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    done = apply_edits(both.where("edits is not null"), tokenizer=tokenizer, pattern=pattern)
    zero = F.lit(0).cast("bigint")
    same = both.where("edits is null").select(
        *_TREE_NAMES, F.col("n_tokens").alias("n_tokens_before"), F.col("n_pretokens").alias("n_pretokens_before"), zero.alias("pretokens_encoded"), zero.alias("chars_encoded")
    )
    return done.unionByName(same)


def sample_edits() -> Column:
    """Three edits that follow from doc_id and text alone: a word put in, a stretch taken out, characters replaced."""
    n, k = F.length("text").cast("bigint"), F.coalesce(F.pmod("doc_id", F.lit(997)), F.lit(0))
    share = lambda m: F.floor(n * (k % m) / m).cast("bigint")
    one = lambda start, removed, inserted: F.struct(start.alias("start"), removed.cast("bigint").alias("removed"), inserted.alias("inserted"))
    return F.array(
        one(share(7), F.lit(0), F.concat(F.lit(" item"), k.cast("string"))),
        one(share(5), F.least(F.lit(12), n), F.lit("")),
        one(share(3) + 1, F.lit(3), F.lit("'ll \n x9")),
    )


def edited_counts(docs: DataFrame, *, tokenizer: str, pattern: str, edits: Column | None = None) -> DataFrame:
    """Token counts of every text before and after ``edits`` (a column over doc_id and text): trees are written once and read back for the edits."""
    from foldspark.llm.shared import Scratch

    scratch = Scratch(docs.sparkSession, "trees")
    trees = scratch.table(write_trees(docs, tokenizer=tokenizer, pattern=pattern), "trees", compression="zstd")
    done = apply_edits(trees.withColumn("edits", sample_edits() if edits is None else edits), tokenizer=tokenizer, pattern=pattern)
    return done.select(
        "doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), F.col("n_pretokens_before").alias("n_pretokens"),
        F.col("n_pretokens").alias("n_pretokens_edited"), "pretokens_encoded", "chars_encoded",
    )
