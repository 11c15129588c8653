"""Tokenizer ids of whole texts, with the ids of pieces between spaces remembered in each worker.

Both vocabularies split a text before its byte pairs are merged, and never
merge across such a split. A space between two other characters is one, so a
text's ids are those of its pieces one after another; natural text repeats
most pieces, and each worker encodes a piece once while it is remembered. The
memory is a cache: emptying it changes no result. A text with the string of a
special token goes to the library whole, which gives that token's id for it.
"""

from __future__ import annotations

import gc
import os
import re

import numpy as np

from tideline.llm.common import kept

#: A piece that ends in ASCII punctuation is cut before it: word and punctuation never merge.
_MARKS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "_")
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]
#: Pairs of white space of which one is a space; those of ASCII texts come first.
_ASCII_RUNS, _ALL_RUNS = (sorted({x for c in _SPACES if ord(c) < limit for x in (f" {c}", f"{c} ")}) for limit in (128, 0x3001))
_OTHER_SPACE = "\x1c\x1d\x1e\x1f"


class PieceEncoder:
    """space_joins: the vocabulary keeps a space with the word after it (byte-level); otherwise it drops white space."""

    def __init__(self, path: str, space_joins: bool, remembered: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.set_threshold(200_000, 20, 20)  # lists of pieces come and go without cycles
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.space_joins, self.remembered = space_joins, remembered
        self.known: dict[str, bytes] = {}

        mark = (lambda t: t.startswith("Ġ")) if space_joins else (lambda t: t.endswith("</w>"))
        edges = {i for t, i in self.tokenizer.get_vocab().items() if mark(t)}
        self.edges = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.edges[list(edges)] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, 500 in one call: a token that begins (or ends) a word tells where each stands."""
        lead, out = " " if self.space_joins else "", []
        parts = [words[i : i + 500] for i in range(0, len(words), 500)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([lead + " ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            at = np.flatnonzero(self.edges[ids])
            if len(at) != len(part):  # letters that the tokenizer splits
                out += self._ids([lead + w for w in part])
                continue
            cuts = 4 * (np.append(at, len(ids)) if self.space_joins else np.concatenate([[0], at + 1]))
            cuts, raw = cuts.tolist(), ids.tobytes()
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces, each with the space before it if that joins."""
        known, lead = self.known, " " if self.space_joins else ""
        words, whole, marked = [], [], []
        for p in pieces:
            if p.isalpha():
                words.append(p)
            elif (w := p.rstrip(_MARKS)) != p and w.isalnum():
                marked.append((p, w))
            else:
                whole.append(p)
        ends = {w for _, w in marked}.difference(known, words)
        words += [w for w in ends if w.isalpha()]
        whole += [w for w in ends if not w.isalpha()]
        known.update(zip(words, self._words(words), strict=True))
        known.update(zip(whole, self._ids([lead + w for w in whole]), strict=True))
        marks = list({p[len(w) :] for p, w in marked})
        bare = dict(zip(marks, self._ids(marks), strict=True))
        for p, w in marked:
            known[p] = known[w] + bare[p[len(w) :]]

    def _pieces(self, text: str) -> tuple[str | None, list[str]]:
        """The first piece where it has no space before it, and all others."""
        if not self.space_joins:
            return None, text.split() if not any(c in text for c in _OTHER_SPACE) else text.split(" ")
        runs = any(x in text for x in (_ASCII_RUNS if text.isascii() else _ALL_RUNS))
        pieces = _INNER_SPACE.split(text) if text[0] == " " or text[-1] == " " or runs else text.split(" ")
        return pieces[0], pieces[1:]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        marked = [i for i, t in enumerate(texts) if any(x in t for x in self.special)]
        if marked:
            whole = dict(zip(marked, self._ids([texts[i] for i in marked]), strict=True))
            rest = iter(self.encode_all([t for i, t in enumerate(texts) if i not in whole]))
            return [whole[i] if i in whole else next(rest) for i in range(len(texts))]
        cut = [self._pieces(t) if t else (None, []) for t in texts]
        new: set[str] = set()
        for _, pieces in cut:
            new.update(set(pieces).difference(known))
        if new:
            self._learn(list(new))
        firsts = iter(self._ids([f for f, _ in cut if f is not None]))
        return [(next(firsts) if f is not None else b"") + b"".join([known[p] for p in pieces]) for f, pieces in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def encoder(path: str, space_joins: bool) -> PieceEncoder:
    """One for each worker process, file and kind."""
    return kept(("encoder", path, space_joins), lambda: PieceEncoder(path, space_joins))
