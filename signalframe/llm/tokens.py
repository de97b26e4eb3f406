"""Token ids of whole texts by the tokenizers library."""

from __future__ import annotations

import json
import os
import re
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from struct import pack

import numpy as np

from .common import released, trimmed

#: Texts of these characters alone: beside space and line feed they hold no white space of any kind and no controls, so
#: that cutting at white space is cutting where the tokenizer's own patterns cut. Others are encoded as a whole.
_PLAIN = re.compile("[\x20\n\x21-\x7e\xa1-˿Ͱ-ӿぁ-ヿ一-鿿]*")
#: Letters whose case and composition raise no question, and marks that no pattern joins to a letter. U+0130 isn't one of
#: them: in lower case it is two characters, which the patterns cut apart.
_L, _P = "[A-Za-zÀ-ÖØ-öø-įı-ž]", "[.,;:!?%#$&*|]"
#: Units: a word and the marks behind it apart, anything else up to white space as a whole; in byte-level form with the
#: one space before it, as such tokenizers join that space to what follows.
_UNITS = {
    False: re.compile(rf"{_L}+(?={_P}*+(?:[ \n]|\Z))|(?<={_L}){_P}+(?=[ \n]|\Z)|\S+"),
    True: re.compile(rf" ?{_L}+(?={_P}*+(?:[ \n]|\Z))|(?<={_L}){_P}+(?=[ \n]|\Z)| ?[^ \n]+|\s+(?!\S)|\s"),
}


#: Units that are one piece to the tokenizer's patterns; its model takes them at once, past the patterns.
_ONE = re.compile(rf" ?{_L}+|{_P}+")


def byte_letters() -> dict[str, str]:
    """How byte-level models write UTF-8: printable bytes as themselves, the others from 256 on, in order; by character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    letter = [other.get(b, chr(b)) for b in range(256)]
    return {chr(c): "".join(letter[b] for b in chr(c).encode()) for c in range(0x180)}


class Ids(dict):
    """ids(texts) gives each text's ids by the library, an array of unsigned 32-bit integers.

    A string of an added token in a text is that token, as the library has it; such texts are encoded as a whole.
    Texts repeat their words, so each unit is encoded once, when it is first asked for, and kept: up to ``most`` of them
    and as many older ones.
    """

    def __init__(self, path: str, most: int = 250_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            words = bool(json.load(f)["model"].get("end_of_word_suffix"))
        self.model, self.units, self.lower, self.letters = self.tokenizer.model, _UNITS[not words], words, str.maketrans(byte_letters())
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.older: dict[str, bytes] = {}
        self.most = most

    def __missing__(self, unit: str) -> bytes:
        found = self.older.get(unit)
        if found is None:
            if _ONE.fullmatch(unit):
                each = [t.id for t in self.model.tokenize((unit.lower() if self.lower else unit).translate(self.letters))]
            else:
                each = self.tokenizer.encode(unit, add_special_tokens=False).ids
            found = pack(f"<{len(each)}I", *each)
        self[unit] = found
        return found

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            if _PLAIN.fullmatch(t) and not any(a in t for a in self.added):
                out.append(np.frombuffer(b"".join(map(self.__getitem__, self.units.findall(t))), "<u4"))
            else:
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4"))
            if len(self) > self.most:
                self.older = dict(self)
                self.clear()
        return out


@cache
def ids_of(path: str) -> Ids:
    """One per worker process, so that what a task has encoded serves the next."""
    return Ids(path)


_tasks = 0


@contextmanager
def encoder(path: str, rest: float = 1.0) -> Iterator[Ids]:
    """The encoder for a task; given back when the worker has had no next task for ``rest`` seconds."""
    global _tasks
    _tasks += 1
    trimmed()
    try:
        yield ids_of(path)
    finally:
        timer = threading.Timer(rest, lambda own=_tasks: own == _tasks and released())
        timer.daemon = True
        timer.start()
