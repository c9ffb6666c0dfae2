"""Token ids of whole texts with the ``tokenizers`` library, fast enough for a corpus.

The tokenizer drops white space and never merges across it, so a text's ids are those of its white-space words in
order. Words repeat; each task keeps the ids of the words it has met (a bounded cache). A new word
of plain letters, digits and punctuation is split by the tokenizer's own rule and its pieces go to the library's BPE
model directly; any other word goes through the library's whole ``encode``.

All of this holds for tokenizer files with the rules RULES. With any other file, whole texts go through the library.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

from .common import give_back

END_ID = 1
#: Words longer than this are encoded but not kept; words up to SHORT bytes are kept in every spelling.
LONGEST_KEPT, SHORT, MOST_WORDS = 48, 8, 800_000

#: The pieces of a lower-cased word by the tokenizer's rule, for ASCII and Latin-1 letters.
_LATIN = "a-zß-öø-ÿ"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\s{_LATIN}0-9]+")
_LETTERS = re.compile(rf"[{_LATIN}]+")
#: The rules of a tokenizer file for which words can be encoded one by one.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_MARKS = frozenset(b".,;:!?")
_PLAIN = re.compile(r"[\x21-\x7eA-Za-zÀ-ÖØ-öø-ÿ]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_chars() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the other bytes for code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """White-space word (UTF-8) -> its ids as little-endian unsigned 32-bit integers.

    A cache of two generations: when the young one is full it becomes the old one, from which what is still used comes
    back. Longer words that are a known one but for case or a last mark are put together each time and not kept."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        model = rules["model"]
        plain = all(x["content"].startswith("<|") and not (x["single_word"] or x["lstrip"] or x["rstrip"]) for x in rules["added_tokens"])
        #: whether the file's rules are those that words and pieces are made by
        self.by_words = plain and model["type"] == "BPE" and not model.get("dropout") and all(rules.get(k) == v for k, v in RULES.items())
        self.model, self.table, self.old = self.tokenizer.model.tokenize, _byte_chars(), {}

    def keep(self, word: bytes, ids: bytes) -> bytes:
        if len(word) <= LONGEST_KEPT:
            if len(self) >= MOST_WORDS // 2:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if (ids := self.old.get(word)) is not None:
            return self.keep(word, ids)
        low = word.lower()
        core, mark = (low[:-1], low[-1:]) if low[-1] in _MARKS else (low, b"")
        if core.isalpha() or (core and not core.isascii() and _LETTERS.fullmatch(core := core.decode().lower()) and (core := core.encode())):
            ids = self.piece(core) + self.piece(mark) if mark else self.piece(core)
            return self.keep(word, ids) if len(word) <= SHORT and word != core else ids
        text = word.decode()
        if len(text) <= 4096 and _PLAIN.fullmatch(text) and "<|" not in text:
            return self.keep(word, b"".join([self.piece(p.encode()) for p in _PIECE.findall(text.lower())]))
        return self.keep(word, array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())

    def piece(self, piece: bytes) -> bytes:
        """A lower-cased piece of the tokenizer's rule."""
        if (ids := self.get(piece)) is not None:
            return ids
        if (ids := self.old.get(piece)) is None:
            spelled = piece.decode() if piece.isascii() else piece.decode("latin-1").translate(self.table)
            ids = array("I", [t.id for t in self.model(spelled)]).tobytes()
        return self.keep(piece, ids)


_END = array("I", [END_ID]).tobytes()
_kept: dict[str, _Words] = {}


def encoder(path: str) -> Callable[[str | None], bytes]:
    """Gives the ids of a text (null: empty) with the end id, as little-endian unsigned 32-bit integers."""
    if path not in _kept:
        _kept[path] = _Words(path)
    words = _kept[path]
    look, whole = words.__getitem__, words.tokenizer.encode

    def encode(text: str | None) -> bytes:
        return b"".join(map(look, text.encode().split())) + _END if text else _END

    def encode_whole(text: str | None) -> bytes:
        return array("I", whole(text, add_special_tokens=False).ids).tobytes() + _END if text else _END

    return encode if words.by_words else encode_whole


def forget() -> None:
    """Empties the caches at the end of a task, so that the worker's next one has the memory."""
    for words in _kept.values():
        words.clear()
        words.old = {}
    give_back()


def pieces(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids cut at every ``capacity``."""
    step = 4 * capacity
    for k, at in enumerate(range(0, len(ids), step)):
        part = ids[at : at + step]
        yield k, at // 4, len(part) // 4, zlib.crc32(part)


def texts(batches: Iterable, column: str = "text") -> Iterator[tuple[object, list]]:
    """(batch, its texts) for each Arrow batch that has rows."""
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(batch.schema.get_field_index(column)).to_pylist()
