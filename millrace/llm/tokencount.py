"""Edit-aware token counts: a segment tree of pre-tokens per document.

A text is cut into pre-tokens by the tokenizer's pattern; each is encoded on its own, so a text's count is the sum of its
pre-tokens' counts. Some places are boundaries whatever lies around them: before white space behind anything else; between an ASCII
letter or digit and an ASCII mark; between two letters of scripts written without spaces, or such a letter and a mark of theirs,
where no entry of the vocabulary holds the two bytes that meet (no merge can cross them). A leaf is a run of pre-tokens, or of
pieces of a long one, of about LEAF characters between such places (characters, tokens): a leaf for each pre-token would make the
tree many times as large as its text. Inner nodes hold sums.

A batch of edits finds the leaves that hold the characters from the second before each edit to the first behind it; the outer
boundaries of neighbouring ones are untouched, so only these leaves are encoded again, and only sums above them change. If they
become more leaves than they were, sums are added up anew over all leaves; no other leaf is encoded. The text is put together
once for a batch.

The tree travels as two arrays in heap order (node 1 is the root, node i has children 2i and 2i + 1) beside its text, so a
later batch of edits needs the text and the arrays, not a new count. Building is one pass with no shuffle; edits from a table
are joined by document id.

Edge cases: a null or empty text has no pre-tokens and one empty leaf; a text without such places is one leaf; edits are (start,
stop, insert) in code points of the unedited text, cut to its bounds, null inserts counting as deletion; an edit that overlaps one
that starts before it (of equal starts: ends before it) applies to the rest of its range; repeated rows each get a row; other
columns are dropped.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 256
EDITS = "array<struct<start:bigint,stop:bigint,insert:string>>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: The pre-token pattern of the byte-level vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Letters of scripts written without spaces (kana, ideographs), and marks between them.
_CJK, _CJK_MARK = "\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5", "\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
#: A pre-token ends here, or (a CJK letter before another one) may be cut here.
_PLACE = re.compile(rf"\S(?=[ \t-\r])|[A-Za-z0-9](?=[!-/:-@\[-`{{-~])|[{_CJK}](?=[{_CJK}{_CJK_MARK}])")


@cache
def counter(vocabulary: str, pattern: str = PATTERN) -> Counter:
    return Counter(vocabulary, pattern)


class Counter:
    def __init__(self, vocabulary: str, pattern: str) -> None:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # Pairs of bytes that meet inside some entry.
        self.meets = np.zeros((256, 256), bool)
        for entry in ranks:
            if len(entry) > 1:
                x = np.frombuffer(entry, np.uint8)
                self.meets[x[:-1], x[1:]] = True

    def place(self, text: str, at: int) -> int:
        """The first boundary behind a character at or after `at`; the text's end if there is none."""
        for m in _PLACE.finditer(text, at):
            end = m.end()
            if m[0] < "\u3041" or not self.meets[m[0].encode()[-1], text[end].encode()[0]]:
                return end
        return len(text)

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of each leaf of a text that starts at a boundary."""
        encode, sizes, counts, at, n = self.coder.encode_ordinary, [], [], 0, len(text)
        while at < n:
            end = self.place(text, at + LEAF) if n - at > LEAF + LEAF // 2 else n
            sizes.append(end - at)
            counts.append(len(encode(text[at:end])))
            at = end
        return sizes or [0], counts or [0]


class Tree:
    """Sums of characters and tokens over leaves, in heap order."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.chars, self.tokens = chars, tokens
        self.width = len(chars) // 2

    @classmethod
    def of(cls, chars: list[int], tokens: list[int]) -> Tree:
        width = 1 << max(0, (len(chars) - 1).bit_length())
        out = []
        for leaves in (chars, tokens):
            heap = np.zeros(2 * width, np.int64)
            heap[width : width + len(leaves)] = leaves
            at = width
            while at > 1:
                heap[at // 2 : at] = heap[at : 2 * at].reshape(-1, 2).sum(1)
                at //= 2
            out.append(heap)
        return cls(*out)

    def find(self, offset: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds the character at offset; the last one beyond the end."""
        if offset >= self.chars[1]:
            return self.width - 1, int(self.chars[1] - self.chars[-1])
        node, first = 1, 0
        while node < self.width:
            node *= 2
            if offset - first >= self.chars[node]:
                first += int(self.chars[node])
                node += 1
        return node - self.width, first

    def put(self, first: int, chars: list[int], tokens: list[int]) -> None:
        """New values of neighbouring leaves, and new sums above them."""
        for heap, leaves in ((self.chars, chars), (self.tokens, tokens)):
            a = self.width + first
            b = a + len(leaves)
            heap[a:b] = leaves
            while a > 1:
                a, b = a // 2, (b + 1) // 2
                heap[a:b] = heap[2 * a : 2 * b].reshape(-1, 2).sum(1)


def build(text: str, c: Counter) -> Tree:
    return Tree.of(*c.leaves(text))


def ordered(edits: list[dict] | None, size: int) -> list[tuple[int, int, str]]:
    """Edits in order, within the text, without overlaps."""
    out, last = [], 0
    for e in sorted(edits or (), key=lambda e: (e["start"], e["stop"])):
        a = min(max(e["start"], last, 0), size)
        b = min(max(e["stop"], a), size)
        out.append((a, b, e["insert"] or ""))
        last = b
    return out


def edit(text: str, tree: Tree, edits: list[tuple[int, int, str]], c: Counter) -> tuple[str, Tree, int]:
    """(new text, new tree, tokens of what was encoded again); edits as from ordered()."""
    groups: list[list] = []  # first and last leaf, bounds in the text, edits
    for e in edits:
        i, a = tree.find(max(0, e[0] - 2))
        j, first = tree.find(e[1])
        b = first + int(tree.chars[tree.width + j])
        if groups and i <= groups[-1][1]:
            groups[-1][1], groups[-1][3] = max(j, groups[-1][1]), max(b, groups[-1][3])
            groups[-1][4].append(e)
        else:
            groups.append([i, j, a, b, [e]])
    out, done, again, new, grown = [], 0, 0, [], False
    for i, j, a, b, own in groups:
        parts, at = [], a
        for start, stop, insert in own:
            parts += [text[at:start], insert]
            at = stop
        part = "".join([*parts, text[at:b]])
        out += [text[done:a], part]
        done = b
        chars, tokens = c.leaves(part)
        again += sum(tokens)
        grown |= len(chars) > j - i + 1
        new.append((i, j, chars, tokens))
    out.append(text[done:])
    if grown:
        leaves = [], []
        for k, heap in enumerate((tree.chars, tree.tokens)):
            old, at = heap[tree.width :].tolist(), 0
            for i, j, *both in new:
                leaves[k].extend(old[at:i] + both[k])
                at = j + 1
            leaves[k].extend(old[at:])
        return "".join(out), Tree.of(*leaves), again
    for i, j, chars, tokens in new:
        spare = [0] * (j - i + 1 - len(chars))
        tree.put(i, chars + spare, tokens + spare)
    return "".join(out), tree, again


def _ints(heaps: list[np.ndarray]) -> pa.Array:
    head = np.concatenate([[0], np.cumsum([len(h) for h in heaps])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(head), pa.array(np.concatenate(heaps) if heaps else np.zeros(0, np.int64)))


def token_trees(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Per row: doc_id, text, edits (of the column named, else null), n_tokens, chars, tokens."""
    vocabulary = vocabulary or default_vocabulary()
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        c = counter(vocabulary)
        for b in batches:
            trees = [build(t or "", c) for t in b.column(1).to_pylist()]
            total = pa.array([int(t.tokens[1]) for t in trees], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, total, _ints([t.chars for t in trees]), _ints([t.tokens for t in trees])], ["doc_id", "text", "edits", "n_tokens", "chars", "tokens"])

    with_edits = (F.col(edits) if edits else F.lit(None)).cast(EDITS).alias("edits")
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), with_edits)
    return src.mapInArrow(run, f"doc_id {kind}, text string, edits {EDITS}, n_tokens long, chars array<long>, tokens array<long>")


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Trees with the edits of a table (doc_id, start, stop, insert) in their column `edits`."""
    lists = edits.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("insert").cast("string").alias("insert"))).alias("edits"))
    return trees.drop("edits").join(lists, "doc_id", "left").select("doc_id", "text", F.col("edits").cast(EDITS).alias("edits"), "n_tokens", "chars", "tokens")


def apply_edits(trees: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per row of trees: doc_id, text (edited), n_edits, n_before, n_tokens, n_encoded (tokens of what was encoded again), chars, tokens."""
    vocabulary = vocabulary or default_vocabulary()
    kind = trees.schema["doc_id"].dataType.simpleString()

    def run(batches):
        c = counter(vocabulary)
        for b in batches:
            texts, lists = b.column("text").to_pylist(), b.column("edits").to_pylist()
            chars, tokens = b.column("chars"), b.column("tokens")
            n_edits, again, after, heaps = [], [], [], []
            for i, (t, e) in enumerate(zip(texts, lists, strict=True)):
                tree = Tree(chars[i].values.to_numpy().copy(), tokens[i].values.to_numpy().copy())
                todo, n = ordered(e, len(t or "")), 0
                if todo:
                    texts[i], tree, n = edit(t or "", tree, todo, c)
                n_edits.append(len(todo))
                again.append(n)
                after.append(int(tree.tokens[1]))
                heaps.append(tree)
            cols = [b.column("doc_id"), pa.array(texts, pa.string()), pa.array(n_edits, pa.int64()), b.column("n_tokens"), pa.array(after, pa.int64()), pa.array(again, pa.int64()), _ints([t.chars for t in heaps]), _ints([t.tokens for t in heaps])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "n_edits", "n_before", "n_tokens", "n_encoded", "chars", "tokens"])

    return trees.mapInArrow(run, f"doc_id {kind}, text string, n_edits long, n_before long, n_tokens long, n_encoded long, chars array<long>, tokens array<long>")
