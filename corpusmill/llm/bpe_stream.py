"""BPE as a streaming transducer with bounded lookahead, and decoding as an incremental state machine.

Encoding. Two tokens may stand side by side in a tokenization iff no merge would have crossed their border while both
sides grew, and a sequence is the tokenization of its bytes iff all its neighbours may (merge lists in which every rule
comes after those that make its parts). So each prefix of a piece has exactly one last token that fits the last token of
what stands before it; `Transducer` keeps that token for the last few places only. As a token has at most `longest`
bytes, any later token starts at one of the last `longest` places: what all of them share on the way back is stable and
is emitted, and places before it are forgotten. `sufficient_lookahead` bounds how far back a byte can change a token: what
ends further back is emitted even if the ways have not met, so that never more is pending, whatever the piece.

Texts go through in portions of pieces, pieces in portions of bytes, and ids at once into the digest and the decoder, so
the memory for one text does not grow with it, but for the text itself.

Decoding. `Decoder` turns ids to bytes and bytes to text in steps, holding back only an unfinished UTF-8 sequence
(three bytes at most); broken sequences become U+FFFD as in the tokenizers' own decoders.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm.batches import held_in_worker, keyed_text, map_batches
from corpusmill.llm.vocab import Memo, Vocabulary, piece_utf8, pieces_by, read_vocabulary, vocabulary

BPE_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Borders:
    """Whether two tokens may be neighbours, from their merge histories."""

    def __init__(self, vocab: Vocabulary, limit: int = 200_000) -> None:
        self.vocab = vocab
        #: By the right token: whether the left one may stand before it; `limit` answers at most.
        self.known: list[dict[int, bool] | None] = [None] * len(vocab.lengths)
        self.held, self.limit = 0, limit
        self.rights: dict[int, list[tuple[int, int]]] = {}
        self.lefts: dict[int, list[tuple[int, int]]] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(symbol at the border, rank at which it is merged away), oldest first."""
        out, gone = [], 1 << 60
        while True:
            out.append((token, gone))
            if token not in self.vocab.parts or self.vocab.born[token] < 0:
                return out[::-1]
            gone = self.vocab.born[token]
            token = self.vocab.parts[token][side]

    def fit(self, left: int, right: int) -> bool:
        answers = self.known[right]
        known = answers.get(left) if answers else None
        if known is None:
            if self.held >= self.limit:
                self.known[:] = [None] * len(self.known)
                self.held = 0
            if self.known[right] is None:
                self.known[right] = {}
            known = self.known[right][left] = self._fit(left, right)
            self.held += 1
        return known

    def _fit(self, left: int, right: int) -> bool:
        if (xs := self.rights.get(left)) is None:
            xs = self.rights[left] = self._spine(left, 1)
        if (ys := self.lefts.get(right)) is None:
            ys = self.lefts[right] = self._spine(right, 0)
        merges, i, j = self.vocab.merges, 0, 0
        while True:
            (x, x_gone), (y, y_gone) = xs[i], ys[j]
            # A merge across the border wins over the right side's own at the same rank, as it stands further left.
            if (found := merges.get((x, y))) and found[0] < x_gone and found[0] <= y_gone:
                return False
            if x_gone == y_gone == 1 << 60:
                return True
            if x_gone <= y_gone:
                i += 1
            if y_gone <= x_gone:
                j += 1


def sufficient_lookahead(vocab: Vocabulary) -> int:
    """A bound, in bytes, on how much right context can change a token.

    New bytes change a border only by a merge (a, b) that takes the symbol a from a later merge (c, a') whose right part
    ends where a ends, which frees c in turn, and so on: ranks rise along such a chain. The longest chain is found over
    the merges by falling rank, joined by right-hand symbols that end with the taken one; each link moves by at most
    the length of its left part, and the first by one whole token.
    """
    by_last: dict[int, int] = {}
    best = 0
    strings, longest = vocab.strings, vocab.longest
    for (a, b), _ in sorted(vocab.merges.items(), key=lambda x: -x[1][0]):
        end = strings[a][-1]
        reach = len(strings[a]) + by_last.get(end, 0)
        last = strings[b][-1]
        by_last[last] = max(by_last.get(last, 0), reach)
        best = max(best, reach)
    return best + longest


#: First bytes of a short piece after which the state is kept, and such states at most (about 8 MB).
HEAD, HEADS = 5, 30_000


class Transducer:
    """Takes the bytes of one piece in any portions and emits its tokens as they become stable."""

    def __init__(self, vocab: Vocabulary, borders: Borders, lookahead: int | None = None) -> None:
        self.vocab, self.borders = vocab, borders
        self.lookahead = sufficient_lookahead(vocab) if lookahead is None else lookahead
        self.heads: dict[bytes, list[int]] = {}
        self.reset()

    def reset(self) -> None:
        self.base = 0  # place of lasts[0]
        self.lasts: list[int] = [-1]  # last token of each prefix; -1: nothing is pending there
        self.tail = b""  # the bytes after base

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        step = 4 * self.vocab.longest
        for at in range(0, len(data), step):
            self._advance(data[at : at + step])
            if len(self.lasts) > 2 * self.vocab.longest:
                out += self._stable()
        return out

    def finish(self) -> list[int]:
        out = self._back(len(self.lasts) - 1)
        self.reset()
        return out

    def whole(self, data: bytes) -> list[int]:
        """The tokens of a short piece at once: nothing of it would be emitted before its end. What stands at the places of
        its first bytes does not depend on the others, and is kept for pieces that start alike."""
        head = data[:HEAD]
        if (lasts := self.heads.get(head)) is not None:
            self.lasts, self.tail = lasts.copy(), head
        else:
            self._advance(head)
            if len(self.heads) >= HEADS:
                self.heads.clear()
            self.heads[head] = self.lasts.copy()
        if len(data) > HEAD:
            self._advance(data[HEAD:])
        return self.finish()

    def _advance(self, data: bytes) -> None:
        done, tail, lasts = len(self.tail), self.tail + data, self.lasts
        merged, known, fit = self.vocab.merged, self.borders.known, self.borders.fit
        lengths_by_end, endings, few = self.vocab.lengths_by_end, self.vocab.endings, (2, 1)
        for end in range(done + 1, len(tail) + 1):
            # The longest token that ends here; all others that do are its own endings.
            for length in lengths_by_end.get(tail[end - 3 : end], few) if end > 2 else few:
                if length <= end and (token := merged.get(tail[end - length : end])) is not None:
                    break
            for length, token in endings[token]:
                last = lasts[end - length]
                if last < 0:  # the piece starts here
                    fits = True
                elif (answers := known[token]) is None or (fits := answers.get(last)) is None:
                    fits = fit(last, token)
                if fits:
                    lasts.append(token)
                    break
            else:
                raise AssertionError(f"no token fits at {self.base + end}")
        self.tail = tail

    def _back(self, place: int) -> list[int]:
        out, lasts, lengths = [], self.lasts, self.vocab.lengths
        while place > 0:
            token = lasts[place]
            out.append(token)
            place -= lengths[token]
        return out[::-1]

    def _stable(self) -> list[int]:
        """Tokens that all ways on share; forgets what stands before."""
        live = set(range(max(1, len(self.lasts) - self.vocab.longest), len(self.lasts)))
        strings, lasts = self.vocab.strings, self.lasts
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(top - len(strings[lasts[top]]))
        shared = live.pop()
        if len(self.lasts) - 1 - shared > self.lookahead + self.vocab.longest:  # the bound decides, as they meet too far back
            shared, least = len(self.lasts) - 1, len(self.lasts) - 1 - self.lookahead
            while shared > least:
                shared -= len(strings[lasts[shared]])
        if shared <= 0:
            return []
        out = self._back(shared)
        # The token that ends at the shared place stays known there, as the next must fit it.
        self._cut(shared)
        return out

    def _cut(self, place: int) -> None:
        self.base += place
        self.tail = self.tail[place:]
        self.lasts = [self.lasts[place], *self.lasts[place + 1 :]]


class Decoder:
    """Ids to text in portions."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        flat, starts = self.vocab.flat_strings
        at, lengths = starts[ids], starts[ids + 1] - starts[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return ""
        places = np.repeat(at - ends + lengths, lengths) + np.arange(ends[-1])
        return self.machine.decode(flat[places].tobytes())

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


#: Bytes of a piece, pieces of a text and ids that are taken at a time.
PIECE_STEP, PIECES_STEP, DECODE_STEP = 1 << 14, 1 << 14, 1 << 16


class Encoder:
    """Texts to ids (uint32 bytes), piece by piece through one transducer with a bounded memo of short pieces."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.transducer = Transducer(vocab, Borders(vocab))
        self.memo = Memo(self._piece)

    def _piece(self, piece: bytes | str) -> bytes:
        data = piece_utf8(piece)
        if len(data) >= self.vocab.longest:
            return b"".join(self._portions(piece))
        out = self.transducer.whole(data)
        return pack(f"<{len(out)}I", *out)

    def _portions(self, piece: bytes | str) -> Iterator[bytes]:
        data = piece_utf8(piece)
        for at in range(0, len(data), PIECE_STEP):
            out = self.transducer.feed(data[at : at + PIECE_STEP])
            yield pack(f"<{len(out)}I", *out)
        out = self.transducer.finish()
        yield pack(f"<{len(out)}I", *out)

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids in portions."""
        for k, part in enumerate(self.vocab.segments(text)):
            if k % 2:
                yield pack("<I", self.vocab.special[part])
                continue
            for some in pieces_by(part, PIECES_STEP):
                if max(map(len, some), default=0) <= PIECE_STEP:
                    yield b"".join(map(self.memo.__getitem__, some))
                else:
                    for piece in some:
                        yield from self._portions(piece)


def encoder(data: bytes) -> Encoder:
    """One in each Python worker, until the worker does something else."""
    return held_in_worker(("encoder", len(data), hash(data)), lambda: Encoder(vocabulary(data)))


def decode_ids(vocab: Vocabulary, ids: np.ndarray) -> Iterator[str]:
    machine = Decoder(vocab)
    for at in range(0, len(ids), DECODE_STEP):
        yield machine.feed(ids[at : at + DECODE_STEP].astype(np.int64))
    yield machine.finish()


def encode_decode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Token count, digest of the ids and digest of the text decoded from them, for each row; the ids if wanted.

    Null and empty texts have no tokens and the digests of nothing; repeated rows are repeated; strings of special
    tokens become their ids. A map without shuffles; a task holds one Arrow batch, bounded memos and, of a piece, what the
    lookahead lets be pending.
    """
    data = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocab_path))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        enc = encoder(data.value)
        counts, ids_sha, text_sha, all_ids = [], [], [], []
        for text in batch.column(1).to_pylist():
            n, of_ids, of_text, machine, kept = 0, hashlib.sha256(), hashlib.sha256(), Decoder(enc.vocab), []
            for packed in enc.encode(text or ""):
                n += len(packed) // 4
                of_ids.update(packed)
                of_text.update(machine.feed(np.frombuffer(packed, "<u4").astype(np.int64)).encode())
                if keep_ids:
                    kept.append(packed)
            of_text.update(machine.finish().encode())
            counts.append(n)
            ids_sha.append(of_ids.hexdigest())
            text_sha.append(of_text.hexdigest())
            all_ids.append(b"".join(kept))
        yield {"doc_id": batch.column(0), "n_tokens": counts, "ids_sha256": ids_sha, "decoded_sha256": text_sha} | ({"ids": all_ids} if keep_ids else {})

    return map_batches(keyed_text(df, id_col, text_col), run, BPE_SCHEMA + (", ids binary" if keep_ids else ""))
