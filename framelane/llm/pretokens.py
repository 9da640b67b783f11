"""Cutting a text where a sentencepiece BPE model can never merge.

A merge makes a piece of the vocabulary. Two characters that stand next to each other in no piece of the vocabulary are therefore never
in one token, and a text may be cut between them: tokens of the parts are the tokens of the text. ``Cutter`` cuts before every run of
spaces and around every character that occurs in no piece of two characters or more. The parts are the pre-tokens.
"""

from __future__ import annotations

import re
from itertools import chain

import sentencepiece

from framelane.llm.shared import remembered

SPACE = "▁"


class Cutter:
    """One model with byte fallback, a space before every text, and no other change to texts."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, size = self.model, self.model.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        pieces = [sp.id_to_piece(i) for i in plain]
        joined = set("".join(p for p in pieces if len(p) > 1))
        probe = "a  Ωﬁb  c \n"
        if not any(sp.is_byte(i) for i in range(size)) or sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model must have byte fallback, add a space and leave texts as they are")
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece of the model reaches over a space")
        self.alone = next(c for c in "\n" if c not in joined)
        self.before = len(sp.encode(self.alone, num_threads=1))
        runs = "[" + "".join(sorted(map(re.escape, joined - {SPACE, " "}))) + "]+"
        self.cut = re.compile(f" *{runs}| +|.", re.DOTALL).findall
        self.raw = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
        self.known: dict[str, list[int]] = {}
        self.known_chars = 0

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a text, the space before it included; none for an empty text."""
        return self.cut(" " + text.replace(SPACE, " ")) if text else []

    def ids_of(self, pretokens: list[str]) -> list[list[int]]:
        """The ids of each pre-token by itself."""
        own = self.model.encode([p[1:] if p[0] == " " and len(p) > 1 else self.alone + p for p in pretokens], num_threads=1)
        return [ids if p[0] == " " and len(p) > 1 else ids[self.before :] for p, ids in zip(pretokens, own)]

    def encode_all(self, texts: list[str], memory_chars: int = 8_000_000) -> list[list[int]]:
        """The ids of each text. Pre-tokens stay known until they have ``memory_chars`` characters."""
        cut = [self.pretokens(t) for t in texts]
        fresh = list(set(chain.from_iterable(cut)).difference(self.known))
        if self.known_chars > memory_chars:
            self.known, self.known_chars = {}, 0
            fresh = list(set(chain.from_iterable(cut)))
        self.known.update(zip(fresh, self.ids_of(fresh)))
        self.known_chars += sum(map(len, fresh))
        return [list(chain.from_iterable(map(self.known.__getitem__, parts))) for parts in cut]


def cutter(path: str) -> Cutter:
    """The model of a path, read once per Python worker."""
    return remembered(("cutter", path), lambda: Cutter(path))
