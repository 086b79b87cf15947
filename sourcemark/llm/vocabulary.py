"""Splitting whole texts into words for the tokenizers, and a bounded cache of what a word gives.

A tokenizer that drops white space never joins symbols across it, so the tokens of a text are the
tokens of its white-space-free runs, one after the other. Runs repeat, so tasks look them up.
"""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from types import ModuleType

from pyspark import Broadcast
from pyspark.sql import SparkSession

# White space as Unicode's property has it. str.split() also splits at these four, which are none.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
NOT_SPACE = re.compile("[\x1c-\x1f]")
BLOCK = 1 << 20
FILE_LIMIT = 64 << 20


# Runs of printable ASCII and composed Latin letters, whose lower case is one letter each.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")
# Fixed by the vocabulary file: how it cuts such runs in lower case. Bytes beyond ASCII are letters' here.
PLAIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u0080-\uffff]+|[0-9]|[^a-z0-9\u0080-\uffff]+")
# Whole texts of such runs and ASCII white space, and the same cut between white space.
PLAIN_BLOCK = re.compile(f"[\t-\r {PLAIN.pattern[1:-2]}]*")
PLAIN_BLOCK_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u017f]+|[0-9]|[^\\sa-z0-9\u00df-\u017f]+")
# Fixed by the vocabulary file: the normaliser and the splitter that the cuts above are equal to.
NORMALISER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}


class Cutter:
    """Cuts white-space-free runs as the vocabulary does: special strings, then normalised pieces.

    Plain runs are cut here; the library's own normaliser and splitter cut the others.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        rules = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        normaliser, splitter = (json.loads(rule.__getstate__()) if rule is not None else {} for rule in rules)
        steps = splitter.get("pretokenizers", [])
        if normaliser != NORMALISER or [s.get("pattern", {}).get("Regex") for s in steps] != [SPLITTER, None]:
            raise ValueError("this vocabulary normalises or splits in another way than the cuts made here")
        self.normalise = self.tokenizer.normalizer.normalize_str
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.letters = byte_letters()
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(f"({'|'.join(special)})") if special else None

    def parts(self, word: str) -> list[str]:
        """``word`` around its special strings, which stand at the odd places."""
        return [word] if self.special is None or "<" not in word else self.special.split(word)

    def block_pieces(self, block: str) -> list[str] | None:
        """Lower-cased pieces of a whole text of plain runs, in one go; None if it holds anything else."""
        if PLAIN_BLOCK.fullmatch(block) is None or ("<" in block and self.special is not None and self.special.search(block)):
            return None
        return PLAIN_BLOCK_PIECES.findall(block.lower())

    def lettered(self, piece: str) -> str:
        """A piece in the letters that stand for its bytes."""
        return piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)

    def pieces(self, word: str) -> list[str]:
        """Pieces in the letters that stand for their bytes."""
        if PLAIN.fullmatch(word):
            return PLAIN_PIECES.findall(self.lettered(word.lower()))
        return [piece for piece, _ in self.split(self.normalise(word))]


def shared_file(spark: SparkSession, path: str) -> Broadcast:
    """A vocabulary file for all executors; its size is checked, as it is broadcast."""
    size = os.path.getsize(path)
    if size > FILE_LIMIT:
        raise ValueError(f"{path} has {size} bytes; at most {FILE_LIMIT} are broadcast")
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def split_words(text: str) -> list[str]:
    if NOT_SPACE.search(text):
        return [w for w in SPACE.split(text) if w]
    return text.split()


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """``text`` in pieces of about ``size`` that end at white space, so no word is cut."""
    start = 0
    while len(text) - start > size:
        cut = SPACE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


class WordCache:
    """What words give, in two generations of ``limit`` entries: the older one is dropped whole."""

    def __init__(self, compute: Callable[[list[str]], Iterable], limit: int = 150_000, longest: int = 64):
        self.compute, self.limit, self.longest = compute, limit, longest
        self.young: dict = {}
        self.old: dict = {}

    def lookup(self, words: list[str]) -> list:
        """Values of ``words``, in order; unknown ones are computed together."""
        young, old = self.young, self.old
        out = list(map(young.get, words))
        if None not in out:
            return out
        missing, long = [], {}
        for word in {w for w, value in zip(words, out, strict=True) if value is None}:
            if len(word) > self.longest:
                long[word] = None
            elif word in old:
                young[word] = old[word]
            else:
                missing.append(word)
        if missing:
            young.update(zip(missing, self.compute(missing), strict=True))
        if long:
            long = dict(zip(long, self.compute(list(long)), strict=True))
            out = [young[w] if w not in long else long[w] for w in words]
        else:
            out = list(map(young.__getitem__, words))
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return out


def kept(key: object, make: Callable[[], object]):
    """``make()``, once per worker process and key; the last one made stays for later tasks.

    It hangs on a module of the process, as the globals of functions that travel are new per task.
    """
    store = _store()
    if store.get("key") != key:
        forget()
        store.update(key=key, value=make())
    return store["value"]


def forget() -> None:
    """Drop what an earlier job of this worker process has kept."""
    for name in ("key", "value"):
        _store().pop(name, None)


def _store() -> dict:
    return vars(sys.modules.setdefault("_sourcemark_kept", ModuleType("_sourcemark_kept")))
