"""Token ids of whole texts by the tokenizers library, each different word encoded once.

For tokenizers whose pre-tokens never reach over white space, a text's ids are those of its
words, and a word's are those of its letters and of the stops behind them. So words are
told apart by Arrow, and the library sees only words it has not met: its model those of plain
letters, the whole tokenizer all others, many at a time with a special token between them.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words a worker remembers, bytes of these and their ids, and words given to the library at once.
MEMO, MEMO_BYTES, AT_ONCE = 1 << 21, 256 << 20, 512
#: Stops that follow an ASCII letter or digit at the end of a word are a pre-token of their own.
_STOPS = r"^(?s:(?P<stem>.*[a-z0-9])(?P<stops>[.,;:!?]+))$"
#: In tokenizers that fit, so is any ASCII punctuation without apostrophes.
_SIGNS = r"^(?s:(?P<stem>.*[a-z0-9ß-öø-ÿ])(?P<stops>[!-&(-/:-@\[-`{-~]+))$"
#: Words that normalizing and splitting leave as they are, and the bytes in them that the model
#: knows by other characters than those of Latin-1.
_LETTERS = r"^[a-zß-öø-ÿ]+$"
_BYTES = np.arange(256, dtype="<u4")
_BYTES[0x80:0xA1], _BYTES[0xAD] = np.arange(290, 323), 323
#: What a tokenizer does before its model, for ``WordIds`` to be exact.
_NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def fits(path: str, separator: str = "<|endoftext|>") -> bool:
    """Whether the tokenizer at ``path`` is one whose ids ``WordIds`` gives."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    added = found.get("added_tokens") or []
    plain = all(t["content"].startswith("<|") and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added)
    return (
        plain
        and any(t["content"] == separator for t in added)
        and (found.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
        and (found.get("pre_tokenizer") or {}).get("pretokenizers") == _PRE_TOKENIZERS
        and not any(found.get(x) for x in ("post_processor", "truncation", "padding"))
        and not found["model"].get("dropout")
    )


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes ``start .. start + length - 1`` of every range, one range after another."""
    ends = np.cumsum(lengths)
    index = np.repeat(starts - (ends - lengths), lengths)
    index += np.arange(len(index))
    return index


class WordIds:
    def __init__(self, path: str, separator: str = "<|endoftext|>"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.separator, self.mark = separator, self.library.token_to_id(separator)
        self.model = self.library.model if fits(path, separator) else None
        self.words = pa.array([], pa.string())
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        if not self.model:
            return self._whole(words.to_pylist())
        bare = pc.match_substring_regex(words, _LETTERS)
        letters = np.frombuffer("\n".join(words.filter(bare).to_pylist()).encode(), np.uint8)
        spelled = _BYTES[letters].tobytes().decode("utf-32-le").split()
        found = [[t.id for t in self.model.tokenize(w)] for w in spelled]
        others, sizes = self._whole(words.filter(pc.invert(bare)).to_pylist())
        flat = np.concatenate([np.array([i for ids in found for i in ids], np.uint32), others])
        # Both kinds, in the order of the words.
        sizes = np.concatenate([np.array([len(ids) for ids in found], np.int64), sizes])
        place = np.empty(len(words), np.int64)
        bare = bare.to_numpy(zero_copy_only=False)
        place[bare], place[~bare] = np.arange(len(found)), np.arange(len(found), len(words))
        lengths = sizes[place]
        return flat[_ranges((np.cumsum(sizes) - sizes)[place], lengths)], lengths

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by the whole tokenizer."""
        flat, lengths = [], []
        between = f" {self.separator} "
        for at in range(0, len(words), AT_ONCE):
            part = words[at : at + AT_ONCE]
            ids = np.array(self.library.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) != len(part) - 1:  # a word that holds the separator itself
                own = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(part, add_special_tokens=False)]
                flat += own
                lengths += map(len, own)
                continue
            flat.append(np.delete(ids, marks))
            lengths += np.diff(np.concatenate([[-1], marks, [len(ids)]])).__sub__(1).tolist()
        return np.concatenate([np.zeros(0, np.uint32), *flat]), np.array(lengths, np.int64)

    def _known(self, words: pa.Array) -> np.ndarray:
        """Places of different ``words`` in the memory, which takes in those that are new."""
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            full = len(self.words) + at.null_count > MEMO or self.words.nbytes + self.flat.nbytes > MEMO_BYTES
            if full and len(self.words):
                self.words, self.flat, self.starts = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)
                return self._known(words)
            new = words.filter(at.is_null())
            flat, lengths = self._encode(new)
            self.flat = np.concatenate([self.flat, flat])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
            places = at.to_numpy(zero_copy_only=False)
            places[np.isnan(places)] = np.arange(len(self.words), len(self.words) + len(new))
            self.words = pa.concat_arrays([self.words, new])
            return places.astype(np.int64)
        return at.to_numpy(zero_copy_only=False).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings; null: none), and the end of each text's ids."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        plain = pc.match_substring(words, "<|")  # a special token's letters keep their case
        lower = pc.if_else(plain, words, pc.ascii_lower(words))
        cut = pc.extract_regex(lower, _SIGNS if self.model else _STOPS)
        whole = pc.or_(plain, cut.is_null())
        stem = pc.if_else(whole, lower, pc.struct_field(cut, "stem"))
        stops = pc.if_else(whole, "", pc.struct_field(cut, "stops"))
        halves = pa.concat_arrays([stem.cast(pa.string()), stops.cast(pa.string())]).dictionary_encode()
        place = self._known(halves.dictionary)[halves.indices.to_numpy()].reshape(2, len(words))
        # Ids of every different word: those of its two halves.
        starts, sizes = self.starts[place], self.starts[place + 1] - self.starts[place]
        ids = self.flat[_ranges(starts.T.ravel(), sizes.T.ravel())]
        n = sizes.sum(0)
        first = np.cumsum(n) - n
        code = coded.indices.to_numpy()
        lengths = n[code]
        ends = np.append(0, np.cumsum(lengths))[split.offsets.to_numpy()]
        return ids[_ranges(first[code], lengths)], ends[1:]
