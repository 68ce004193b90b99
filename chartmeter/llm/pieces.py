"""SentencePiece BPE encoding by a table of last tokens per prefix, and decoding.

Merging pairs by score gives the one sequence of tokens in which every token, and every
two neighbours, merge to exactly themselves. So each prefix of a text has one last token,
and it is found from left to right: of the tokens that end at a place (an automaton of all
pieces names them), the one that is compatible with the last token of what lies before it.
The ids are then read off backwards from the end. The work grows with the length of the
text, without a merge queue. Pieces hold the space mark only at their start, so texts are
cut before it without changing any id, and cut pieces that occur again are remembered.
"""

from __future__ import annotations

import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartmeter.llm.common import map_arrow, per_task, worker_cache

SPACE = "▁"
#: Cut pieces of a text that a worker remembers, and the longest of these in characters.
MEMO, MEMO_CHARS = 200_000, 48
#: Tested pairs that a worker remembers.
PAIRS = 400_000

_CUT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Encoder:
    """Ids of a SentencePiece BPE model whose normalizer leaves texts as they are."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids, ranked = {}, []
        for i in range(sp.vocab_size()):
            if sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i):
                continue
            piece = sp.id_to_piece(i)
            if SPACE in piece.lstrip(SPACE):
                raise ValueError("a piece holds the space mark after other characters")
            self.ids[piece] = i
            ranked.append((-sp.get_score(i), i, piece))
        if sp.normalize("  AÅﬁ \n") != SPACE * 3 + "AÅﬁ" + SPACE + "\n":
            raise ValueError("only models with an identity normalizer are supported")
        #: Pieces in the order in which merging makes them.
        self.rank = {piece: k for k, (*_, piece) in enumerate(sorted(ranked))}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[str]:
        """``text`` merged pair by pair, best score first, leftmost first."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            ranks = [rank.get(a + b, len(rank)) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == len(rank):
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether ``left`` (empty: nothing) and ``right`` stay two tokens when merged."""
        known = self.fits.get((left, right))
        if known is None:
            known = self.merged(left + right) == ([left, right] if left else [right])
            self.fits[left, right] = known
        return known

    def tokens(self, cut: str) -> list[str]:
        """Tokens of a cut piece; a character without a token is one of its own."""
        last: list[str | None] = [None] * (len(cut) + 1)
        fits = self.fits
        for end, piece in self.automaton.iter(cut):
            end += 1
            if last[end] is None:
                # Nothing ends after a character without a token: merging starts anew there.
                left = last[end - len(piece)] or ""
                fit = fits.get((left, piece))
                if fit is None:
                    fit = self.compatible(left, piece)
                if fit:
                    last[end] = piece
        out, end = [], len(cut)
        while end:
            out.append(last[end] or cut[end - 1])
            end -= len(out[-1])
        return out[::-1]

    def cut_ids(self, cut: str) -> tuple[int, ...]:
        out: list[int] = []
        for token in self.tokens(cut):
            i = self.ids.get(token)
            out.extend([i] if i is not None else (self.bytes[b] for b in token.encode()))
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, without begin and end ids; none for an empty one."""
        if not text:
            return []
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        if len(self.fits) > PAIRS:
            self.fits.clear()
        cuts = _CUT.findall(SPACE + text.replace(" ", SPACE))
        extra = {}
        for cut in set(cuts).difference(memo):
            (memo if len(cut) <= MEMO_CHARS else extra)[cut] = self.cut_ids(cut)
        if extra:
            return list(chain.from_iterable(memo[c] if c in memo else extra[c] for c in cuts))
        return list(chain.from_iterable(map(memo.__getitem__, cuts)))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def encode(df: DataFrame, model_file: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with its ``ids`` (array of int) and, if named, the text that these decode to.

    A null text is empty: no ids, an empty decoded text. All other columns and all rows
    are kept as they are, a column of a new one's name is replaced. ``model_file`` is read
    in every executor, at the same path.
    """
    kept = df.drop(*([ids] + ([decoded] if decoded and decoded != text else [])))
    added = {ids: "array<int>"} | ({decoded: "string"} if decoded else {})
    out = kept.drop(text) if decoded == text else kept
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields]
    schema = ", ".join(fields + [f"`{n}` {t}" for n, t in added.items()])
    names = [f.name for f in out.schema.fields]

    def task():
        encoder = worker_cache(("pieces", model_file), lambda: Encoder(model_file))

        def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [encoder.encode(t or "") for t in batch.column(text).to_pylist()]
            columns = [batch.column(n) for n in names] + [pa.array(found, pa.list_(pa.int32()))]
            if decoded:
                columns.append(pa.array([encoder.decode(i) for i in found], pa.string()))
            return pa.record_batch(columns, names + list(added))

        return rows

    return map_arrow(kept, per_task(task), schema, text)


def decode(df: DataFrame, model_file: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with ``text``, decoded from its array column ``ids``; null ids give a null text."""

    def decoded(batches):
        encoder = worker_cache(("pieces", model_file), lambda: Encoder(model_file))
        for batch in batches:
            found = [None if i is None else encoder.decode(i) for i in batch.column(ids).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, text])

    kept = df.drop(text)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    return kept.mapInArrow(decoded, ", ".join([*fields, f"`{text}` string"]))


def digests(df: DataFrame) -> DataFrame:
    """``doc_id`` with the number and digest of the ids and the digest of the decoded text."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
