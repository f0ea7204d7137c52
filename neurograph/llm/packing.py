"""Operator 8, hierarchical packing of documents into windows of several context sizes.

A document is its token ids and an end id. Whole windows of the longest tier are cut from it at once; what is left goes to the smallest tier
that holds it. Tiers are packed from the longest down: a window takes one piece of its own tier, then the largest whole pieces of shorter tiers
that fit its gap, and at last the first part of a short piece, so windows are full. Full windows are powers of two and need no padding.
Windows of a block are dealt to step groups of equal token counts, long ones first.

Each task packs the rows of its own input split, block by block: nothing is shuffled, and a task holds one block of tokens. What a block
leaves over is carried to the next; at the end of a task it is cut into powers of two. Sequence ids count within a task, above the number
of the input partition, and are the same when a lost task runs again.

Defined results: a null text is an empty document, of the end id alone; repeated rows are packed each; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from neurograph.llm.common import map_batches

TIERS = (2048, 1024, 512, 256)
#: Tokens that a task gathers before it packs them, and tokens of a step group.
BLOCK, STEP = 1 << 20, 1 << 15


#: Longest text that may hold a run of white space as long as itself: on runs of about a million the fast library's engine overflows its stack.
LONGEST_RUN = 100_000
_RUN = re.compile(rf"\s{{{LONGEST_RUN}}}")
#: Texts of these characters only (Latin letters and usual punctuation) are classed alike by every version of the pattern's engines.
_COMMON = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")


class Ids:
    """A text's ids as the library ``tokenizers`` gives them for a byte-level BPE file, as little-endian 32-bit bytes.

    With the same vocabulary as ranks the library ``tiktoken`` gives the same ids in a fifth of the time, so texts of common characters go
    there; all others, those that hold an added token or a very long run of white space, and what that library refuses, go to ``tokenizers``. The
    string of an added token (``<|endoftext|>``) in a text is one id, as that library's plain call gives it.
    """

    def __init__(self, path: str, ranks: str | None, pattern: str | None):
        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(ranks).read_bytes().splitlines())}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def of(self, text: str) -> bytes:
        if self.fast and not _COMMON.search(text) and not any(t in text for t in self.added) and not (len(text) >= LONGEST_RUN and _RUN.search(text)):
            try:
                return array("I", self.fast.encode_ordinary(text)).tobytes()
            except BaseException as e:  # the pattern's engine gives up on some very long texts, by an error of its own that is no Exception
                if not isinstance(e, (ValueError, RuntimeError)) and type(e).__name__ != "PanicException":
                    raise
        return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str, ranks: str | None, pattern: str | None) -> Ids:
    """Loaded once in each worker."""
    return Ids(path, ranks, pattern)


class Packer:
    """Packs pieces (document, start, length) block by block. ``pack`` and ``finish`` give windows: (window, step group, pieces)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step: int = STEP):
        self.tiers, self.step, self.groups, self.room = tiers, step, 0, 0
        self.full: list[tuple[int, list]] = []
        self.waiting: dict[int, list] = {t: [] for t in tiers}

    def add(self, doc: int, length: int) -> None:
        """Routes a document."""
        longest, start = self.tiers[0], 0
        while length - start >= longest:
            self.full.append((longest, [(doc, start, longest)]))
            start += longest
        self._route(doc, start, length - start)

    def _route(self, doc: int, start: int, length: int) -> None:
        if length:
            self.waiting[min(t for t in self.tiers if t >= length)].append((doc, start, length))

    def _fill(self, pieces: list, gap: int, shorter: list[int], queues: dict[int, deque]) -> int:
        """Adds pieces of shorter tiers to a window; gives the gap that stays."""
        for t in shorter:
            q = queues[t]
            while q and q[-1][2] <= gap:  # queues are sorted, the longest piece last
                piece = q.pop()
                pieces.append(piece)
                gap -= piece[2]
        for t in reversed(shorter):
            q = queues[t]
            while gap and q:
                doc, start, length = q.popleft()
                take = min(gap, length)
                pieces.append((doc, start, take))
                gap -= take
                if take < length:
                    q.appendleft((doc, start + take, length - take))
        return gap

    def pack(self, last: bool = False) -> list[tuple[int, int, list]]:
        """Packs what was added; what fills no window waits for the next block, or is cut into powers of two if this is the ``last``."""
        queues = {t: deque(sorted(self.waiting[t], key=lambda p: (p[2], p[0], p[1]))) for t in self.tiers}
        self.waiting = {t: [] for t in self.tiers}
        left: list = []
        for k, t in enumerate(self.tiers):
            q, shorter = queues[t], list(self.tiers[k + 1 :])
            while q:
                pieces = [q.pop()]
                gap = t - pieces[0][2]
                if not shorter:  # the shortest tier fills its own gaps
                    while gap and q:
                        doc, start, length = q.pop()
                        take = min(gap, length)
                        pieces.append((doc, start, take))
                        gap -= take
                        if take < length:
                            q.append((doc, start + take, length - take))
                elif gap:
                    gap = self._fill(pieces, gap, shorter, queues)
                if gap:
                    left += pieces
                else:
                    self.full.append((t, pieces))
        self._cut(left, last)
        return self._grouped()

    def _cut(self, left: list, last: bool) -> None:
        """Leftovers end to end, cut into the longest windows; a rest waits, or is cut into falling powers of two."""
        total = sum(p[2] for p in left)
        sizes = [self.tiers[0]] * (total // self.tiers[0])
        rest = total % self.tiers[0]
        if last:
            sizes += [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        queue = deque(left)
        for size in sizes:
            pieces, gap = [], size
            while gap:
                doc, start, length = queue.popleft()
                take = min(gap, length)
                pieces.append((doc, start, take))
                gap -= take
                if take < length:
                    queue.appendleft((doc, start + take, length - take))
            self.full.append((size, pieces))
        for piece in queue:
            self._route(*piece)

    def _grouped(self) -> list[tuple[int, int, list]]:
        """Deals windows to step groups, the longest first; the group that the block before left open is filled first. Sizes are powers of two, so a
        group is filled exactly unless no window is short enough for its last gap."""
        out, later = [], []
        for w in sorted(self.full, key=lambda w: -w[0]):
            if w[0] <= self.room:
                self.room -= w[0]
                out.append((w[0], self.groups - 1, w[1]))
            else:
                later.append(w)
        for window, pieces in later:
            if self.room < window:
                self.groups, self.room = self.groups + 1, self.step
            self.room -= window
            out.append((window, self.groups - 1, pieces))
        self.full = []
        return out


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, window bigint, step_group bigint"


def pack_documents(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, end_id: int = 1, key: str = "doc_id", text: str = "text", with_ids: bool = False, block: int = BLOCK) -> DataFrame:
    """One row for each piece, and the piece's ids if ``with_ids``. ``path`` is the tokenizer's file; ``ranks`` and ``pattern`` are the same vocabulary for tiktoken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer, part = tokenizer(path, ranks, pattern), Packer(), TaskContext.get().partitionId() << 40
        end, held, ids, number, tokens, sequence = end_id.to_bytes(4, "little"), {}, {}, 0, 0, part

        def rows(windows: list) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            for k in range(0, len(windows), 4096):
                cols: list[list] = [[] for _ in range(10)]
                for window, group, pieces in windows[k : k + 4096]:
                    offset = 0
                    for doc, start, length in pieces:
                        raw = held[doc][4 * start : 4 * (start + length)]
                        for c, v in zip(cols, (ids[doc], start, length, zlib.crc32(raw), len(held[doc]) // 4, sequence, offset, window, part + group), strict=False):
                            c.append(v)
                        if with_ids:
                            cols[9].append(raw)
                        offset += length
                    sequence += 1
                arrays = [pa.array(c, pa.int64()) for c in cols[:9]]
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                if with_ids:
                    ends = pa.array([0, *accumulate(len(x) // 4 for x in cols[9])], pa.int32())
                    arrays.append(pa.ListArray.from_arrays(ends, pa.Array.from_buffers(pa.int32(), sum(map(len, cols[9])) // 4, [None, pa.py_buffer(b"".join(cols[9]))])))
                    names = [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = ids_of.of(text or "")
                held[number], ids[number] = raw + end, k
                packer.add(number, len(raw) // 4 + 1)
                tokens += len(raw) // 4 + 1
                number += 1
            if tokens >= block:
                yield from rows(packer.pack())
                open_docs = {p[0] for q in packer.waiting.values() for p in q}
                held, ids, tokens = {d: held[d] for d in open_docs}, {d: ids[d] for d in open_docs}, 0
        yield from rows(packer.pack(last=True))

    return map_batches(docs.select(docs[key].cast("bigint").alias("doc_id"), text), run, SCHEMA + ", ids array<int>" * with_ids, 256)
