"""Packing: documents cut into pieces that fill windows of tokens, balanced by multiway differencing.

Each document's tokens are its ids followed by one closing id. Whole windows are cut from the front of a document; the rest is
cut into parts that the Karmarkar-Karp method spreads over windows of nearly equal length: the two partial partitions with the
largest spread are merged again and again, the fullest windows of one on the emptiest of the other. If a window then exceeds the
capacity, the number of windows rises and the differencing is run again.

Documents are packed in groups of consecutive rows of one input split, so no row is shuffled, the memory of a task is bounded by one
group and a lost task can be run again with the same result; other splits give other groups. A group has GROUP documents or more,
until they fill some fifty windows, as its last windows are padded: half a window on average.

Defined cases: a null or empty text is one piece that holds the closing id alone; very long texts become many whole windows;
repeated rows are packed each by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.llm.shared import kept_caches, tidy

CAPACITY, END_ID, GROUP, PART = 2048, 1, 512, 256
CACHED_WORDS = 1_000_000
#: Characters of text that end a group early, those that it has at least, and its most documents.
HELD, LEAST_HELD, MOST_GROUP = 8_000_000, 400_000, 50_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_tokenizers = kept_caches.setdefault("packing", {})


#: A text without such characters gives the same pieces in lower case: its letters are composed and have one lower-case letter each.
_ODD = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: The end of a word before closing marks; a piece never holds letters or digits and marks, but for 's and its like, which don't end in a mark.
_MARKS = re.compile("(?<=[a-z0-9\xdf-\xf6\xf8-\xff])(?=[!-/:-@\\[-`{-~]+(?:[ \n]|$))")


class WordIds(dict):
    """Ids of white-space separated words as little-endian bytes. The vocabulary's pieces never cross white space, so a text's ids are its words' ids in turn; only a cache of words is kept."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.ends = np.zeros(tokenizer.get_vocab_size(), bool)
        self.ends[[i for word, i in tokenizer.get_vocab().items() if word.endswith("</w>")]] = True

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, new: list[str]) -> None:
        """Words of letters alone are one piece each, so a whole list is encoded at once and cut after each piece's last id."""
        plain = [w for w in new if w.isalpha() and not _ODD.search(w)]
        for lo in range(0, len(plain), 2000):
            part = plain[lo : lo + 2000]
            ids = self.ids(" ".join(part))
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            if len(cuts) == len(part):
                self.update(zip(part, (raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True))
        for word in new:
            if word not in self:
                self[word] = self.ids(word).tobytes()

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        words, ends = [], []
        for t in texts:
            if not _ODD.search(t) and "<|" not in t:  # a special token may begin so
                t = _MARKS.sub(" ", t.lower())
            words += t.replace("\n", " ").split(" ")
            ends.append(len(words))
        ids = list(map(self.get, words))
        new = [k for k, x in enumerate(ids) if x is None]
        if len(self) + len(new) > CACHED_WORDS:
            self.clear()
        self.learn(list({words[k] for k in new}))
        for k in new:
            ids[k] = self[words[k]]
        return [b"".join(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def tokenizer_at(path: str) -> WordIds:
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = WordIds(Tokenizer.from_file(path))
    return _tokenizers[path]


def difference(sizes: np.ndarray, ways: int) -> np.ndarray:
    """The window of each size: Karmarkar-Karp largest differencing into so many windows. Ties go by position."""
    n = len(sizes)
    if ways == 1:
        return np.zeros(n, int)
    # A node has its sums, ascending and less their least, and where each came from: (left, right, left's windows, right's windows).
    heap, made = [], []
    for i, size in enumerate(sizes.tolist()):
        sums = np.zeros(ways, np.int64)
        sums[-1] = size
        heap.append((-size, i, sums))
        made.append(None)
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        sums = left + right[::-1]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        sums -= sums[0]
        made.append((a, b, order, ways - 1 - order))
        heapq.heappush(heap, (-int(sums[-1]), len(made) - 1, sums))
    out, todo = np.zeros(n, int), [(heap[0][1], np.arange(ways))]
    while todo:
        node, window = todo.pop()
        if made[node] is None:
            out[node] = window[-1]
            continue
        a, b, from_a, from_b = made[node]
        for child, came in ((a, from_a), (b, from_b)):
            own = np.empty(ways, int)
            own[came] = window
            todo.append((child, own))
    return out


def balanced(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Windows of the sizes, each at most capacity in sum, and their number."""
    ways = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(sizes, ways)
        if np.bincount(window, sizes, ways).max() <= capacity:
            return window, ways
        ways += 1


def pieces_of(lengths: list[int], capacity: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(document's index, start, length) of pieces by window and the window of each; whole windows come first."""
    whole, rest = [], []
    for d, n in enumerate(lengths):
        cut = n - n % capacity
        whole += [(d, s, capacity) for s in range(0, cut, capacity)]
        rest += [(d, s, min(part, n - s)) for s in range(cut, n, part)]
    if not rest:
        return np.array(whole, np.int64).reshape(-1, 3), np.arange(len(whole)), np.arange(len(whole)), len(whole)
    parts = np.array(rest, np.int64)
    window, ways = balanced(parts[:, 2], capacity)
    pieces = np.concatenate([np.array(whole, np.int64).reshape(-1, 3), parts])
    window = np.concatenate([np.arange(len(whole)), window + len(whole)])
    return pieces, window, np.lexsort((pieces[:, 1], pieces[:, 0], window)), len(whole) + ways


def packed_group(ids: list, tokens: list[bytes], first: int, capacity: int, part: int) -> tuple[dict, int]:
    lengths = [len(t) // 4 for t in tokens]
    pieces, window, order, ways = pieces_of(lengths, capacity, part)
    out: dict = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
    last, at = -1, 0
    for k in order.tolist():
        d, start, n = pieces[k].tolist()
        w = int(window[k])
        if w == last and out["doc_id"] and last_doc == d and out["start"][-1] + out["length"][-1] == start:
            # Neighbouring parts of one document that meet in a window are one piece.
            out["length"][-1] += n
            out["ids_crc32"][-1] = zlib.crc32(tokens[d][4 * start : 4 * (start + n)], out["ids_crc32"][-1])
            at += n
            continue
        if w != last:
            last, at = w, 0
        last_doc = d
        for name, value in zip(out, (ids[d], start, n, zlib.crc32(tokens[d][4 * start : 4 * (start + n)]), lengths[d], first + w, at), strict=True):
            out[name].append(value)
        at += n
    return out, ways


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP, part: int = PART) -> DataFrame:
    """Pieces of docs (doc_id, text) in sequences of at most capacity tokens; tokenizer is the path of a vocabulary file."""
    closing = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, n = tokenizer_at(tokenizer), TaskContext.get().partitionId() << 40
        ids: list = []
        texts: list[str] = []
        held = 0

        def flush():
            nonlocal n, ids, texts, held
            out, ways = packed_group(ids, [x + closing for x in words.of(texts)], n, capacity, part)
            n, ids, texts, held = n + ways, [], [], 0
            return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= HELD or len(ids) >= MOST_GROUP or (len(ids) >= group and held >= LEAST_HELD):
                    yield flush()
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy("packing", run), SCHEMA)
