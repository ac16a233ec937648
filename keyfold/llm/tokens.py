"""Tokenizer helper: whole texts to ids, exactly as the library gives them.

The library encodes about a megabyte a second and core.  Text repeats its
words, so each distinct space-separated piece is encoded once per Python
worker and looked up from then on.  That is exact where no token can reach
across the cut; any other text is encoded whole.
"""

from __future__ import annotations

from itertools import chain

import numpy as np

#: Pieces that a worker remembers unless it is told otherwise; beyond, it
#: forgets those that it has not met again and goes on.
MEMORY = 1_300_000


class _Pieces(dict):
    """Piece -> number; a new one is numbered and noted as pending."""

    def __init__(self):
        self.pending: list[str] = []

    def __missing__(self, piece):
        self[piece] = n = len(self)
        self.pending.append(piece)
        return n


class Encoder:
    """``encode(texts)`` gives the flat ids and the number of ids per text.

    ``joined`` says whether a space belongs to the word behind it (byte-level
    vocabularies) or is dropped (word vocabularies).  In the first kind a cut
    is exact only at a single space between two other characters; texts with
    another run of white space at a space are encoded whole.
    """

    def __init__(self, path: str, memory: int | None = None):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.tok = Tokenizer.from_str(text)
        normalizer = json.dumps(json.loads(text)["normalizer"] or "").replace("\\\\", "\\")
        self.joined, self.folds = "\\s+" not in normalizer, '"Lowercase"' in normalizer
        self.stops = {p: self.tok.encode(p, add_special_tokens=False).ids for p in (".", ",")}
        # byte-level tokens that begin with a space, or word vocabularies' last tokens
        vocab = self.tok.get_vocab()
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for t, i in vocab.items() if (t[:1] == "\u0120" if self.joined else t.endswith("</w>"))]] = True
        self.memory = memory
        self._forget()

    def _forget(self) -> None:
        self.known = _Pieces()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int32)
        self.uses = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _age(self, most: int) -> None:
        """Forget the pieces met once, and beyond ``most`` those met least; what
        stays must be met again to stay the next time."""
        names, uses = list(self.known), self.uses
        keep = np.flatnonzero(uses[: len(names)] > 1)
        if len(keep) > most:
            keep = np.sort(keep[np.argsort(-uses[keep], kind="stable")[:most]])
        length = self.length[keep]
        flat = self._gather(self.at[keep], np.maximum(length, 0))
        self._forget()
        self.known.update(zip(map(names.__getitem__, keep.tolist()), range(len(keep))))
        self._put(np.arange(len(keep)), flat, length)
        self.uses[: len(keep)] = np.minimum(uses[keep], 64) // 2

    def _room(self, pieces: int, ids: int) -> None:
        while ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while pieces > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
            self.uses = np.concatenate([self.uses, np.zeros_like(self.uses)])

    def _gather(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The ids that stand at these places, one after another."""
        stop = np.cumsum(length, dtype=np.int64)
        return self.ids[np.repeat(at - (stop - length), length) + np.arange(int(stop[-1]) if len(stop) else 0)]

    def _put(self, which: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> None:
        """Note the ids of these pieces; a count of -1 has none in ``flat``."""
        self._room(len(self.known), self.used + len(flat))
        sizes = np.maximum(counts, 0)
        self.ids[self.used : self.used + len(flat)] = flat
        self.length[which] = counts
        self.at[which] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)

    def _many(self, which: np.ndarray, words: list[str]) -> list[int]:
        """Encode words of letters 64 to a text, told apart by the ids that
        open (or close) a word; gives the places of the words for which that failed."""
        lead = " " if self.joined else ""
        texts = [lead + " ".join(words[k : k + 64]) for k in range(0, len(words), 64)]
        lists = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        per = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(per.sum()))
        edge = self.edge[flat]
        upto = np.concatenate([[0], np.cumsum(edge)])
        stop = np.cumsum(per)
        held = np.minimum(len(words) - np.arange(len(lists)) * 64, 64)
        good = (upto[stop] - upto[stop - per] == held) & (per > 0)
        good[good] = edge[(stop - per if self.joined else stop - 1)[good]]
        ok = np.repeat(good, per)
        flat, edge = flat[ok], edge[ok]
        cuts = np.flatnonzero(edge)
        cuts = np.append(cuts, len(flat)) if self.joined else np.append(0, cuts + 1)
        fine = np.repeat(good, held)
        self._put(which[fine], flat, np.diff(cuts))
        return np.flatnonzero(~fine).tolist()

    def _learn(self) -> None:
        new = self.known.pending
        if not new:
            return
        first = len(self.known) - len(new)
        mark = "\x00" if self.joined else ""  # tells a text's first piece from later ones
        # letters and one full stop or comma: the vocabularies cut between them;
        # ASCII letters in a word vocabulary, which folds their case
        letters, plain = [], []
        alias: dict = {stop: ([], []) for stop in (None, *self.stops)}
        of, find = len(new), self.known.__getitem__
        for i, p in enumerate(new[:]):
            if p.isalpha():
                if self.folds and p.isascii() and not p.islower():
                    same = alias[None]
                    same[0].append(i)
                    same[1].append(find(p.lower()))
                else:
                    letters.append(i)
            elif p[-1:] in self.stops and p[:-1].removeprefix(mark).isalpha():
                core, same = p[:-1], alias[p[-1]]
                same[0].append(i)
                same[1].append(find(core.lower() if self.folds and core.isascii() and core.isalpha() else core))
            else:
                plain.append(i)
        for i in range(of, len(new)):  # the words that aliases stand for
            (letters if new[i].isalpha() else plain).append(i)
        self._room(len(self.known), self.used)
        plain = [letters[k] for k in self._many(np.array(letters, np.int64) + first, [new[i] for i in letters])] + plain
        texts = [new[i] for i in plain]
        if self.joined:
            texts = [p[1:] if p[:1] == mark else " " + p for p in texts]
        lists = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        if self.joined:  # -1: this piece makes its text one to encode whole
            for at, i in enumerate(plain):
                p = new[i]
                later = p[:1] != mark
                body = p if later else p[1:]
                if mark in body or p[-1:].isspace() or body[:1].isspace() or not p or (body == "" and not later):
                    lists[at] = None
        counts = np.array([-1 if x is None else len(x) for x in lists], np.int64)
        flat = np.fromiter(chain.from_iterable(x for x in lists if x), np.uint32, int(np.maximum(counts, 0).sum()))
        self._put(np.array(plain, np.int64) + first, flat, counts)
        for stop, (which, cores) in alias.items():
            which, cores = np.array(which, np.int64) + first, np.array(cores, np.int64)
            at, length = self.at[cores], self.length[cores]
            if stop is None:  # the same ids in the same place
                self.at[which], self.length[which] = at, length
            else:
                last = np.array(self.stops[stop], np.uint32)
                behind = np.repeat(np.cumsum(length, dtype=np.int64), len(last))
                self._put(which, np.insert(self._gather(at, length), behind, np.tile(last, len(which))), length + len(last))
        new.clear()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > (self.memory or MEMORY):
            self._age((self.memory or MEMORY) // 2)
        split, counts = [], []
        for t in texts:
            if self.joined:
                pieces = t.split(" ") if t else []
                if pieces:
                    pieces[0] = "\x00" + pieces[0]
            else:
                for c in "\t\n\x0b\x0c\r":
                    if c in t:
                        t = t.replace(c, " ")
                pieces = t.split(" ")
            split.append(pieces)
            counts.append(len(pieces))
        n = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, sum(counts))
        self._learn()
        self.uses[: len(self.known)] += np.bincount(n, minlength=len(self.known)).astype(np.int32)
        length, per_text = self.length[n], np.array(counts, np.int64)
        owner = np.repeat(np.arange(len(texts)), per_text)
        whole = np.zeros(len(texts), bool)
        whole[owner[length < 0]] = True
        if whole.any():
            length = np.where(whole[owner], 0, length)
        flat = self._gather(self.at[n], length)
        sizes = np.bincount(owner, weights=length, minlength=len(texts)).astype(np.int64)
        if not whole.any():
            return flat, sizes
        parts, ends = [], np.cumsum(sizes)
        redone = iter(self.tok.encode_batch_fast([texts[i] for i in np.flatnonzero(whole)], add_special_tokens=False))
        for i in range(len(texts)):
            part = np.array(next(redone).ids, np.uint32) if whole[i] else flat[ends[i] - sizes[i] : ends[i]]
            sizes_i = len(part)
            parts.append(part)
            counts[i] = sizes_i
        return np.concatenate(parts), np.array(counts, np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, memory: int | None = None) -> Encoder:
    """One encoder per Python worker and vocabulary (the first call's memory holds)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, memory)
    return _ENCODERS[path]


def forget_encoders() -> None:
    _ENCODERS.clear()


def batches(texts: list, most: int = 1 << 20):
    """Index ranges of about ``most`` characters."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= most:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(texts):
        yield a, len(texts)
