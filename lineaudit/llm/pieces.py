"""Byte-fallback piece encoding with a merge-type model, exact without running the merges.

The text is cut before every run of blanks and between Latin letters and other characters
(no piece of the vocabulary crosses such a place; that is checked when the model is read),
and again between two characters that no piece holds side by side. Within a cut:

* one Aho-Corasick scan over the reversed cut gives the longest piece at every position;
* pieces are laid left to right; a piece may follow another if merging the two joined
  texts from characters gives back exactly this pair (remembered by pair);
* where nothing fits, the position is marked in a bitfield and the last piece gives way to
  its next shorter prefix.

The result is the only sequence whose neighbours are all compatible, which is the merge
result whenever merges are strictly ordered. The vocabulary gives equal scores to runs of
blanks only; runs of two or more are therefore merged directly, leftmost first.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_CUT = re.compile(f"{BLANK}*(?:[{_LATIN}]+|[^{_LATIN}{BLANK}]+)|{BLANK}+")
_MEMO, _MEMO_CHARS = 600_000, 48
_RESULT = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>"


class Pieces:
    """Vocabulary of a model file, with encoder and decoder."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_of = {i: int(self.text[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes_of.items()}
        self.silent = {i for i in range(n) if sp.is_control(i)}
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {self.text[i]: i for i in normal}
        self.score = {self.text[i]: sp.get_score(i) for i in normal}
        self.singles = {p for p in self.id if len(p) == 1}
        tied = {p for p in self.id if set(p) != {BLANK}}
        if any(not _CUT.fullmatch(p) or not set(p) <= self.singles for p in self.id) or len(
                {self.score[p] for p in tied}) < len(tied):
            raise ValueError("the vocabulary crosses cuts, ties merges or lacks characters")
        self.reversed = ahocorasick.Automaton()
        for p in self.id:
            self.reversed.add_word(p[::-1], len(p))
        self.reversed.make_automaton()
        self.shorter: dict[str, str | None] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.inner = {p[k:k + 2] for p in self.id for k in range(len(p) - 1)}
        self.memo: dict[str, str | tuple[str, str]] = {}

    def merged(self, text: str) -> list[str]:
        """The merges themselves: best score first, leftmost on ties. For pairs and runs of blanks."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(parts) and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, whole = heapq.heappop(heap)
            if parts[i] is None or right[i] >= len(parts) or parts[i] + parts[right[i]] != whole:
                continue
            j = right[i]
            parts[i], parts[j], right[i] = whole, None, right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            offer(left[i], i), offer(i, right[i])
        return [p for p in parts if p is not None]

    def compatible(self, a: str, b: str) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[a, b] = self.merged(a + b) == [a, b]
        return known

    def prefix(self, piece: str) -> str | None:
        """The longest shorter piece that ``piece`` starts with."""
        if piece not in self.shorter:
            self.shorter[piece] = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.id), None)
        return self.shorter[piece]

    def _laid(self, cut: str) -> list[str]:
        """Backtracking over known characters."""
        n = len(cut)
        longest = [1] * n
        last = n - 1
        for end, size in self.reversed.iter(cut[::-1]):
            if size > longest[last - end]:
                longest[last - end] = size
        open_at = bytearray(b"\x01") * (n + 1)
        fits, shorter = self.fits, self.shorter
        out: list[str] = []
        pos = 0
        following: str | None = cut[:longest[0]]
        while following is not None:
            piece = following
            before = out[-1] if out else None
            while True:
                end = pos + len(piece)
                if open_at[end]:
                    good = True if before is None else fits.get((before, piece))
                    if good or (good is None and self.compatible(before, piece)):
                        out.append(piece)
                        pos = end
                        following = cut[end:end + longest[end]] if end < n else None
                        break
                piece = shorter[piece] if piece in shorter else self.prefix(piece)
                if piece is None:
                    open_at[pos] = 0
                    following = out.pop()
                    pos -= len(following)
                    break
        return out

    def ids_of_cut(self, cut: str) -> list[int]:
        if cut.startswith(BLANK * 2):
            return [i for p in self.merged(cut) for i in self._ids(p)]
        if self.singles.issuperset(cut):
            return [self.id[p] for p in self._laid(cut)]
        out: list[int] = []
        start = 0
        for k in range(len(cut) + 1):
            if k == len(cut) or cut[k] not in self.singles:
                if k > start:
                    out += [self.id[p] for p in self._laid(cut[start:k])]
                if k < len(cut):
                    out += [self.byte_id[b] for b in cut[k].encode("utf-8")]
                start = k + 1
        return out

    def parts(self, cut: str) -> list[str]:
        """The cut, split again wherever no piece holds the two characters side by side."""
        if cut.startswith(BLANK * 2):
            return [cut]
        inner = self.inner
        at = [0, *(k for k in range(1, len(cut)) if cut[k - 1:k + 1] not in inner), len(cut)]
        return [cut[a:b] for a, b in zip(at, at[1:])]

    def _ids(self, piece: str) -> list[int]:
        return [self.id[piece]] if piece in self.id else [self.byte_id[b] for b in piece.encode("utf-8")]

    def cuts(self, text: str) -> list[str]:
        return _CUT.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for cut in self.cuts(text) for i in self.ids_of_cut(cut)]

    def _spelled(self, ids: list[int]) -> str:
        """The text of some ids, before the leading blank goes; stray bytes become U+FFFD each."""
        out: list[str] = []
        run = bytearray()
        for i in [*ids, -1]:
            if i in self.bytes_of:
                run.append(self.bytes_of[i])
                continue
            while run:
                size = 1 if run[0] < 0x80 else 2 if 0xC2 <= run[0] < 0xE0 else 3 if 0xE0 <= run[0] < 0xF0 else 4
                try:
                    out.append(bytes(run[:size]).decode("utf-8"))
                except UnicodeDecodeError:
                    out.append("�")
                    size = 1
                del run[:size]
            if i >= 0 and i not in self.silent:
                out.append(self.text[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self._spelled(ids)
        return (text[1:] if text.startswith(BLANK) else text).replace(BLANK, " ")

    def _remembered(self, cut: str) -> tuple[str, str]:
        """Ids joined by commas and spelling of a cut; its parts are remembered as well."""
        parts = self.parts(cut)
        if len(parts) == 1:
            got = self.ids_of_cut(cut)
            ids, spelled = ",".join(map(str, got)), self._spelled(got)
        else:
            known = [self.memo.get(p) or self._remembered(p) for p in parts]
            known = [(k, p) if isinstance(k, str) else k for k, p in zip(known, parts)]
            ids, spelled = ",".join(k[0] for k in known), "".join(k[1] for k in known)
        if len(cut) <= _MEMO_CHARS:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            self.memo[cut] = ids if spelled == cut else (ids, spelled)
        return ids, spelled

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of the decoded text; cuts are remembered.
        An entry that spells its own cut holds the ids only."""
        ids, spelled = [], []
        memo = self.memo
        for cut in self.cuts(text):
            known = memo.get(cut)
            if known is None:
                known = self._remembered(cut)
            if isinstance(known, str):
                ids.append(known), spelled.append(cut)
            else:
                ids.append(known[0]), spelled.append(known[1])
        joined = ",".join(ids)
        decoded = "".join(spelled)
        decoded = (decoded[1:] if decoded.startswith(BLANK) else decoded).replace(BLANK, " ")
        return (joined.count(",") + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(),
                hashlib.sha256(decoded.encode("utf-8")).hexdigest())


_loaded: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode_column(path: str, text: Column) -> Column:
    """Ids of a text (null: empty)."""
    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _pieces(path)
        for batch in batches:
            yield pa.array([model.encode(t.as_py() or "") for t in batch], pa.list_(pa.int32()))

    return run(text)


def decode_column(path: str, ids: Column) -> Column:
    """Text of an array of ids (null: empty)."""
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _pieces(path)
        for batch in batches:
            yield pa.array([model.decode(t.as_py() or []) for t in batch], pa.string())

    return run(ids)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row; a null text counts as empty."""
    @F.arrow_udf(_RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _pieces(path)
        kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        for batch in batches:
            rows = [model.digest(t.as_py() or "") for t in batch]
            yield pa.array([dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), r)) for r in rows], kind)

    return docs.select("doc_id", run(F.col("text")).alias("s")).select("doc_id", "s.*")
