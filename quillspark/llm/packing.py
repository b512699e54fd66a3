"""Order-preserving packing by dynamic programming.

Documents in the order of their scan partition form one stream of token ids. Window cuts fall on document or sentence
boundaries, a run of windows between two boundaries being filled to the brim; the programme minimises padding plus a
penalty for every cut (none at a document's end, a little at a sentence's, more inside a sentence). A window from i to
j costs padding P - j + i, so the best i is the smallest f(i) + i in a sliding range, which a monotone queue keeps.

One pass over the corpus, no shuffle: a partition's stream is packed piece by piece in bounded memory, and only its last
window can be short. A sequence whose length is a power of two needs no padding, so that rest is cut at powers of two.
"""

from __future__ import annotations

import array
import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

LENGTH = 1024
END_ID = 0
SENTENCE_COST, TRUNCATION_COST = 1, 4
#: Tokens held before the programme runs over them.
SEGMENT = 150_000
_PARTS = 4  # windows in a run between two boundaries

_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Characters on which the two libraries' classes of letters, numbers and blanks are known to be the same.
_PLAIN = re.compile("[\\t\\n\\r -~¡-ɏ]*+")
_CACHE: dict[str, Encoder] = {}


def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write bytes with: printable Latin-1 bytes are themselves, the
    others, in order, follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids by the tokenizer file at ``path``.

    Texts of common characters go through tiktoken's encoder over the same vocabulary (ids of this file rank its merges),
    which gives the same ids four times as fast; this is checked on a probe when the file is loaded. All other texts, those
    that hold a special token's text (one id, as the library has it), and all texts if the check fails, go through the
    tokenizers library itself.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        letters = _byte_letters()
        with open(path) as f:
            model = json.load(f)
        vocab = model["model"]["vocab"]
        added = [x["content"] for x in model.get("added_tokens", ())]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.strings = {i: bytes(letters[c] for c in word) for word, i in vocab.items() if all(c in letters for c in word)}
        self.fast = None
        try:
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks={b: i for i, b in self.strings.items() if b.decode("utf-8", "replace") not in added}, special_tokens={})
            probe = "It's 12.5% off!! Ünïcode d'été, naïve  spaces\n\n\ttabs-and_signs |a|b| ¡Holaɏ don't we'LL ### 2024-01-02 <| x" * 3
            if self.fast.encode_ordinary(probe) != self.exact.encode(probe, add_special_tokens=False).ids:
                self.fast = None
        except (ImportError, ValueError, KeyError):
            self.fast = None
        ends = np.zeros(1 + max(max(self.strings), self.exact.get_vocab_size(with_added_tokens=True), *(x["id"] for x in model.get("added_tokens", ()))), bool)
        for i, s in self.strings.items():
            ends[i] = s.rstrip(b" \"')")[-1:] in (b".", b"!", b"?", b"\n")
        self.ends = ends

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and _PLAIN.fullmatch(text) and not self.special.search(text):
            return np.frombuffer(array.array("I", self.fast.encode_ordinary(text)), np.uint32)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _CACHE:
        _CACHE[path] = Encoder(path)
    return _CACHE[path]


def choose_cuts(marks: list[int], costs: list[int], length: int = LENGTH, truncation: int = TRUNCATION_COST, parts: int = _PARTS) -> list[int]:
    """Cuts of the stream marks[0]..marks[-1] into windows of at most ``length``.

    ``marks``: boundaries, ascending, at most ``length`` apart; ``costs``: what a cut at each costs. Returns all cuts from
    first to last mark, of least padding plus costs, where a run of up to ``parts`` windows may lie between two marks, all
    but its last one full and each cut inside it costing ``truncation``.
    """
    n = len(marks)
    key, back = [0.0] * n, [(0, 1)] * n  # least cost up to a mark, plus the mark
    key[0] = marks[0]
    queues = [[0] * n for _ in range(parts)]  # marks in rising order of key
    state = [(0, 0, 0)] * parts  # queue's head, its end, and the first mark that never entered it

    def nearest(k: int, j: int, stop: int, out: list[float], how: list[tuple[int, int]]) -> None:
        """Lower ``out`` and ``how`` of marks j to stop where k full windows and one more are cheaper."""
        queue, (head, end, enter), base = queues[k], state[k], (k + 1) * length + k * truncation
        for to in range(j, stop):
            at = marks[to]
            high = at - k * length
            low = high - length
            while enter < to and marks[enter] < high:
                v = key[enter]
                while end > head and key[queue[end - 1]] >= v:
                    end -= 1
                queue[end] = enter
                end += 1
                enter += 1
            while head < end and marks[queue[head]] < low:
                head += 1
            if head < end:
                cost = key[queue[head]] + base - at
                if cost < out[to - j]:
                    out[to - j], how[to - j] = cost, (queue[head], k + 1)
        state[k] = head, end, enter

    j = 1
    while j < n:
        # full windows reach back ``length`` tokens or more, so they never start inside this stretch of marks
        stop = max(j + 1, bisect.bisect_left(marks, marks[j] + length, j, n))
        more, ways = [float("inf")] * (stop - j), [(0, 1)] * (stop - j)
        for k in range(1, parts):
            nearest(k, j, stop, more, ways)
        queue, (head, end, enter) = queues[0], state[0]
        for to in range(j, stop):
            at = marks[to]
            low = at - length
            while enter < to and marks[enter] < at:
                v = key[enter]
                while end > head and key[queue[end - 1]] >= v:
                    end -= 1
                queue[end] = enter
                end += 1
                enter += 1
            while head < end and marks[queue[head]] < low:
                head += 1
            least, how = more[to - j], ways[to - j]
            if head < end:
                cost = key[queue[head]] + length - at
                if cost <= least:  # a tie goes to the single window
                    least, how = cost, (queue[head], 1)
            key[to] = least + costs[to] + at
            back[to] = how
        state[0] = head, end, enter
        j = stop
    cuts, j = [], n - 1
    while j:
        i, k = back[j]
        cuts.append(marks[j])
        cuts += [marks[i] + q * length for q in range(k - 1, 0, -1)]
        j = i
    return [marks[0], *reversed(cuts)]


def powers(n: int, length: int = LENGTH, truncation: int = TRUNCATION_COST) -> list[int]:
    """Lengths that the last ``n`` < ``length`` tokens are cut into: descending powers of two while that costs less than
    padding the rest would."""
    out = []
    while n:
        bits = bin(n).count("1")
        if bits == 1 or length - n <= (bits - 1) * truncation:
            return [*out, n]
        out.append(1 << (n.bit_length() - 1))
        n -= out[-1]
    return out


class _Packer:
    """The stream of one partition."""

    def __init__(self, ends: np.ndarray, first: int, length: int):
        self.ends, self.sequence, self.length = ends, first, length
        self.docs: list[list] = []  # [doc_id, ids, tokens of it already out]
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.docs.append([doc_id, ids, 0])
        self.held += len(ids)
        if self.held >= SEGMENT:
            yield self.flush(False)

    def _marks(self) -> tuple[list[int], list[int]]:
        marks, costs, at = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0
        for _, ids, out in self.docs:
            ids = ids[out:]
            inner = np.flatnonzero(self.ends[ids[:-1]]) + 1 + at
            at += len(ids)
            marks += [inner, np.array([at])]
            costs += [np.full(len(inner), SENTENCE_COST), np.zeros(1, np.int64)]
        marks, costs = np.concatenate(marks), np.concatenate(costs)
        gaps = np.diff(marks)
        if (wide := np.flatnonzero(gaps > self.length)).size:  # sentences longer than a window
            more = np.concatenate([np.arange(marks[i] + self.length, marks[i + 1], self.length) for i in wide])
            marks, costs = np.concatenate([marks, more]), np.concatenate([costs, np.full(len(more), TRUNCATION_COST)])
            order = np.argsort(marks, kind="stable")
            marks, costs = marks[order], costs[order]
        return marks.tolist(), costs.tolist()

    def flush(self, last: bool) -> pa.RecordBatch:
        """Pieces of all whole windows; the tokens of the last one wait for what follows, unless this is the end."""
        marks, costs = self._marks()
        cuts = choose_cuts(marks, costs, self.length)
        if last:
            tail = cuts.pop() - cuts[-1] if len(cuts) > 1 else 0
            for n in powers(tail, self.length):
                cuts.append(cuts[-1] + n)
        else:
            cuts.pop()
        out, edge = [[] for _ in _OUT], 1
        at, offset = 0, 0
        keep: list[list] = []
        for doc in self.docs:
            doc_id, ids, done = doc
            while done < len(ids):
                if edge >= len(cuts):
                    break
                n = min(len(ids) - done, cuts[edge] - at)
                for column, v in zip(out, (doc_id, done, n, zlib.crc32(ids[done : done + n].astype("<u4").tobytes()), len(ids), self.sequence, offset), strict=True):
                    column.append(v)
                done, at, offset = done + n, at + n, offset + n
                if at == cuts[edge]:
                    edge, offset, self.sequence = edge + 1, 0, self.sequence + 1
            if done < len(ids):
                doc[2] = done
                keep.append(doc)
        self.docs, self.held = keep, sum(len(i) - d for _, i, d in keep)
        return C.rows_out(_OUT, out)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    A document's ids are those of the tokenizer file at ``tokenizer``, then id 0; null text counts as empty and is the one id
    0. Every id lies in exactly one piece. Rows that repeat an id are documents of their own. A document of any length is
    cut over as many sequences as it needs. An empty table gives no rows; other columns are not looked at.
    """

    def of(batches):
        from pyspark import TaskContext

        coder = encoder(tokenizer)
        packer = _Packer(coder.ends, TaskContext.get().partitionId() << 33, length)
        for b in C.cut(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), C.texts(b), strict=True):
                ids = coder.ids(text)
                yield from packer.add(doc_id, np.append(ids, np.uint32(END_ID)).astype(np.uint32))
        if packer.docs:
            yield packer.flush(True)

    return docs.select("doc_id", "text").mapInArrow(of, _SCHEMA)
