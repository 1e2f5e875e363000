"""Whole-text token ids by the tokenizers library, with a bounded memo of the units between single spaces.

A byte-level BPE never joins bytes across a space that stands alone between two
other characters: the space opens the next pre-token. Text is therefore cut
there, units seen before are looked up, and the new units of a batch are encoded
together in one call and told apart by their byte lengths. Texts with other
spacing, added tokens, or another kind of tokenizer are encoded plainly.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Units that one process remembers; beyond it the memo starts anew.
MEMO_UNITS = 1_000_000
#: Characters that one plain call encodes at most, where the text has a safe cut.
PLAIN_CHARS = 200_000
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.lengths = np.zeros(self.size, np.int64)
        for token, i in vocab.items():
            self.lengths[i] = len(token)  # one character a byte
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.cuts = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.memo: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def plain(self, text: str) -> bytes:
        parts, at = [], 0
        while self.cuts and len(text) - at > PLAIN_CHARS and (m := _CUT.search(text, at + PLAIN_CHARS)):
            parts.append(text[at : m.start()])
            at = m.start()
        parts.append(text[at:])
        return b"".join(self._bytes(self.tok.encode_batch_fast([p], add_special_tokens=False)[0].ids) for p in parts)

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 4000):
            units = new[at : at + 4000]
            ids = np.array(self.tok.encode_batch_fast([" " + " ".join(units)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.cumsum([len(u.encode()) + 1 for u in units])
            reach = np.cumsum(self.lengths[ids])
            cut = np.searchsorted(reach, ends) + 1
            if len(reach) and reach[-1] == ends[-1] and (reach[cut - 1] == ends).all():
                held, was = ids.tobytes(), 0
                for u, c in zip(units, (cut * self.dtype.itemsize).tolist()):
                    self.memo[u] = held[was:c]
                    was = c
            else:
                for u in units:
                    self.memo[u] = self.plain(" " + u)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (null: empty) as little-endian bytes of self.dtype."""
        if len(self.memo) > MEMO_UNITS:
            self.memo.clear()
        if len(self.heads) > MEMO_UNITS // 4:
            self.heads.clear()
        memo, rows, new, heads = self.memo, [], set(), set()
        for t in texts:
            if not t or not self.cuts or any(a in t for a in self.added):
                rows.append(None)
                continue
            parts = t.split(" ")
            head = parts.pop(0)
            rows.append((head, parts))
            if head not in self.heads:
                heads.add(head)
            new.update(set(parts).difference(memo))
        clean = [u for u in new if u and not u[0].isspace() and not u[-1].isspace()]
        self._learn(clean)
        fit = [h for h in heads if h and not h[-1].isspace()]
        for h, e in zip(fit, self.tok.encode_batch_fast(fit, add_special_tokens=False)):
            self.heads[h] = self._bytes(e.ids)
        out, get = [], memo.__getitem__
        for t, row in zip(texts, rows):
            if not t:
                out.append(b"")
                continue
            try:
                head, parts = row
                out.append(self.heads[head] + b"".join(map(get, parts)))
            except (TypeError, KeyError):  # odd spacing or an added token
                out.append(self.plain(t))
        return out


_held: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each process and vocabulary."""
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]


def release() -> None:
    """Forgets all encoders and what they remember: for tasks of other operators that a worker process goes on to."""
    _held.clear()
