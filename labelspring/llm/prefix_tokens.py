"""Exact token counts at every prefix of a text, for the byte-fallback piece model.

The library merges pieces by score inside a word (a run of spaces and what follows
it; no piece crosses that border).  Its result has two properties: a prefix that ends
at a token border is encoded by the tokens up to there, and a sequence of tokens
is the encoding of its text if each two neighbours are the encoding of theirs.  So
the last token of a prefix is the suffix piece that fits behind the last token of
what is left, and

    count(prefix) = count(prefix without its last token) + 1.

The counts of a word are made once and remembered, so texts need no re-encoding
for truncation or budgets: ``count_at`` and ``fit`` look up sums of word counts.

Defined cases: null text is empty and has no tokens; characters without a piece count
one token for each of their bytes; the special strings are ordinary text, as in the
library.  Repeated rows and null ids give a row each; an empty table an empty result.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from public_tokenizers import path
from pyspark.sql import DataFrame

from labelspring.llm.bpe import Memory
from labelspring.llm.common import keeps, whole_text

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
KEPT_WORDS = 600_000  # words in each of two generations remembered by one worker
KEPT_CHARS = 48
KEPT_PAIRS = 1_000_000
PORTION = 8 << 20  # characters whose new words are worked out together

SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceCounter:
    _shared: dict[str, PieceCounter] = {}

    def __init__(self, file: str):
        from sentencepiece import sentencepiece_model_pb2 as protocol

        model = protocol.ModelProto()
        with open(file, "rb") as f:
            model.ParseFromString(f.read())
        self.score = {p.piece: p.score for p in model.pieces if p.type == protocol.ModelProto.SentencePiece.NORMAL}
        # every end of a piece, and whether it is a piece itself
        self.suffixes = {p[i:]: False for p in self.score for i in range(1, len(p))} | dict.fromkeys(self.score, True)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.endings: dict[str, tuple] = {}
        self.beginnings: dict[str, tuple] = {}
        self.reachable: dict[str, bool] = {}
        self.words: dict[str, list[int]] = {}
        self.totals = Memory(self._total, KEPT_WORDS)  # tokens of a word behind its space

    @classmethod
    def shared(cls, name: str = MODEL) -> PieceCounter:
        """One for each worker process."""
        if name not in cls._shared:
            cls._shared[name] = cls(path(name))
        return cls._shared[name]

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best neighbours, leftmost first among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merges(self, piece: str) -> Iterator[tuple[float, list[str]]]:
        """The score of every merge that makes a piece, in order, and the parts behind it."""
        parts = list(piece)
        while len(parts) > 1:
            scores = [self.score.get(a + b) for a, b in zip(parts, parts[1:])]
            best = max((s for s in scores if s is not None), default=None)
            if best is None:
                return
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            yield best, parts

    def _edge(self, piece: str, side: int) -> tuple:
        """The outermost part of a piece at its end (-1) or its beginning (0), as its merges go on.

        Once for each piece: the first part, and (score, part) after each merge.
        """
        table = self.endings if side else self.beginnings
        known = table.get(piece)
        if known is None:
            known = table[piece] = piece[side], [(score, parts[side]) for score, parts in self._merges(piece)]
        return known

    def _fits(self, left: str, right: str) -> bool:
        """Whether two pieces, each made by its own merges, stay apart.

        Until something merges across their border, both sides go on as they do alone, the better
        merge first.  So their merges are played against each other, and the border is
        tried whenever it would be next.
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        last, ahead = self._edge(left, -1)
        first, behind = self._edge(right, 0)
        i = j = 0
        apart = None
        while apart is None:
            a = ahead[i][0] if i < len(ahead) else None
            b = behind[j][0] if j < len(behind) else None
            across = self.score.get(last + first)
            # among equal scores the leftmost goes first
            if across is not None and (a is None or across > a) and (b is None or across >= b):
                apart = False
            elif a is not None and (b is None or a >= b):
                last = ahead[i][1]
                i += 1
            elif b is not None:
                first = behind[j][1]
                j += 1
            else:
                apart = True
        self.pairs[key] = apart
        return apart

    def _whole(self, piece: str) -> bool:
        """Whether the piece's own letters merge to it."""
        known = self.reachable.get(piece)
        if known is None:
            known = self.reachable[piece] = self.merged(piece) == [piece]
        return known

    def prefix_counts(self, word: str) -> list[int]:
        """Token counts of word[:0], word[:1], ... word."""
        counts, last = [0], [""]
        self._extend(word, counts, last)
        return counts

    def learn(self, words: set[str]) -> None:
        """Remember the totals of words behind their space.

        In sorted order each word goes on where it leaves the one before, so a prefix that
        words share is worked out once.
        """
        counts, last, before = [0], [""], ""
        for w in sorted(words):
            word = SPACE + w.replace(" ", SPACE)
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            del counts[same + 1 :], last[same + 1 :]
            self._extend(word, counts, last)
            self.totals.keep(w, counts[-1])
            before = word

    def learn_words_of(self, texts: list[str]) -> None:
        """``learn`` what is new in texts (an optional step before ``count``)."""
        seen, old = self.totals, self.totals.old
        words = {w for text in texts for w in text.split(" ")} if texts else set()
        self.learn({w for w in words if w and len(w) <= KEPT_CHARS and SPACE not in w and w not in seen and w not in old})

    def _extend(self, word: str, counts: list[int], last: list[str]) -> None:
        """Go on with the counts and last tokens of the prefixes that the lists hold."""
        suffixes, pairs = self.suffixes, self.pairs
        for end in range(len(counts), len(word) + 1):
            # pieces of two letters and more that end here; nothing longer than a known suffix can be one
            found = []
            start = end - 2
            while start >= 0:
                piece = word[start:end]
                kind = suffixes.get(piece)
                if kind is None:
                    break
                if kind and self._whole(piece):
                    found.append((start, piece))
                start -= 1
            for start, piece in reversed(found):
                if start:
                    before = last[start]
                    apart = pairs.get((before, piece))
                    if apart is None:
                        apart = self._fits(before, piece)
                    if not apart:
                        continue
                counts.append(counts[start] + 1)
                last.append(piece)
                break
            else:
                # every prefix has one last token, so it is the letter itself
                piece = word[end - 1]
                counts.append(counts[end - 1] + (1 if piece in self.score else len(piece.encode())))
                last.append(piece)

    def _total(self, word: str) -> int:
        return self.prefix_counts(SPACE + word.replace(" ", SPACE))[-1]

    def word_counts(self, word: str) -> list[int]:
        known = self.words.get(word)
        if known is None:
            known = self.prefix_counts(word)
            if len(word) <= KEPT_CHARS:
                if len(self.words) >= KEPT_WORDS // 8:
                    self.words.clear()
                self.words[word] = known
        return known

    @staticmethod
    def _marked(text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        if not text:
            return 0
        marked = text.replace(SPACE, " ") if SPACE in text else text
        if "  " not in marked and marked[0] != " " and marked[-1] != " ":
            return sum(map(self.totals.__getitem__, marked.split(" ")))
        return sum(self.totals[w[1:]] for w in _WORD.findall(self._marked(text)))

    def fit(self, text: str, budget: int) -> int:
        """``table(text).fit(budget)`` without the words behind the budget."""
        total, end = 0, -1
        for match in _WORD.finditer(self._marked(text)):
            counts = self.word_counts(match[0])
            if total + counts[-1] > budget:
                for n in counts[1:]:
                    if total + n > budget:
                        break
                    end += 1
                break
            total, end = total + counts[-1], match.end() - 1
        return max(0, min(end, len(text)))

    def borders(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Where words begin, with the end of the last, and the tokens up to there."""
        starts, sums = [0], [0]
        for w in words:
            starts.append(starts[-1] + len(w))
            sums.append(sums[-1] + (self.totals[w[1:]] if w[0] == SPACE and SPACE not in w[1:] else self.word_counts(w)[-1]))
        return starts, sums

    def table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)


keeps("prefix", PieceCounter._shared.clear)


class PrefixTable:
    """Counts of all prefixes of one text: sums at word borders, and each word's own counts."""

    def __init__(self, counter: PieceCounter, text: str, starts: list[int] | None = None, sums: list[int] | None = None):
        """``starts`` and ``sums`` as stored by ``prefix_tables``; without them they are made from the text."""
        self.counter, self.text = counter, text
        self.words = _WORD.findall(counter._marked(text))
        self.starts, self.sums = starts, sums  # in marked characters, one ahead of the text's
        if starts is None or sums is None:
            self.starts, self.sums = counter.borders(self.words)

    def count_at(self, end: int) -> int:
        """Tokens of text[:end]."""
        if end <= 0:
            return 0
        i = bisect.bisect_right(self.starts, end + 1) - 1
        if i == len(self.words):
            return self.sums[i]
        return self.sums[i] + self.counter.word_counts(self.words[i])[end + 1 - self.starts[i]]

    def fit(self, budget: int) -> int:
        """The largest ``end`` with all of text[:end] in ``budget`` tokens, and every shorter prefix too."""
        i = bisect.bisect_right(self.sums, budget) - 1
        end = self.starts[i] - 1
        if i < len(self.words):
            for n in self.counter.word_counts(self.words[i])[1:]:
                if self.sums[i] + n > budget:
                    break
                end += 1
        return max(0, min(end, len(self.text)))


def _portions(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column in lists of about PORTION characters."""
    texts, size = [], 0
    for scalar in column:
        texts.append(scalar.as_py())
        size += len(texts[-1])
        if size >= PORTION:
            yield texts
            texts, size = [], 0
    yield texts


def _counts(limit: int, model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter.shared(model)
        for batch in batches:
            n_bytes, n_tokens, fits = [], [], []
            for texts in _portions(batch.column(1)):
                counter.learn_words_of(texts)
                for text in texts:
                    n = counter.count(text)
                    n_bytes.append(len(text) if text.isascii() else len(text.encode()))
                    n_tokens.append(n)
                    fits.append(len(text) if n <= limit else counter.fit(text, limit))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                    pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(fits, pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    return run


def token_counts(docs: DataFrame, limit: int = LIMIT, model: str = MODEL) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (characters that fit the limit) of every row."""
    return whole_text(docs).mapInArrow(
        _counts(limit, model), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    )


def _tables(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter.shared(model)
        for batch in batches:
            row = 0
            for texts in _portions(batch.column(1)):
                counter.learn_words_of(texts)
                found = [counter.borders(_WORD.findall(counter._marked(text))) for text in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(texts)), pa.array([f[0] for f in found], pa.list_(pa.int32())),
                        pa.array([f[1] for f in found], pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "starts", "sums"],
                )
                row += len(texts)

    return run


def prefix_tables(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, starts, sums: the stored prefix table of every text, one entry for each word border.

    ``PrefixTable(counter, text, starts, sums)`` answers the count of any prefix, and the
    longest prefix within any budget, with the program of a single word and no encoding.
    """
    return whole_text(docs).mapInArrow(_tables(model), "doc_id long, starts array<int>, sums array<int>")
