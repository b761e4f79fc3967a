"""Encoding with the public tokenizers, in batches of about equal bytes.

``TextEncoder`` gives whole texts to the library (tokenizers for .json, sentencepiece for .model). A text above a size goes
in parts, cut where the file's normaliser and pre-tokeniser are known to cut as well; where none is known it goes whole.
With ``fewer_rules`` a text skips the rules of the file that cannot change it; the library still gets all of it, and gives
the same ids.

``WordEncoder`` is for vocabularies that drop white space and never merge across it: a text's ids are the joined ids of its
words between ASCII white space. It encodes only words it has not met (in library batches) and gathers the rest from a
bounded memo of earlier library results, at about a third of the library's time on whole texts. ``encoder`` makes one only
when asked to and when the file is of that kind.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from palaver.llm.common import byte_slices, filled, pieces_of, ragged_take, segment_sums, segments

_TAIL = ",.;:!?"


class WordEncoder:
    """ids of texts by the tokenizers library. ``max_words`` bounds the memo; when it is full, it starts anew."""

    def __init__(self, path: str, max_words: int = 600_000, batch_bytes: int = 8_000_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.vocab_size = self.tk.get_vocab_size(with_added_tokens=True)
        self.max_words, self.batch_bytes = max_words, batch_bytes
        self.last = np.zeros(self.vocab_size, dtype=bool)
        for token, i in self.tk.get_vocab(with_added_tokens=False).items():
            self.last[i] = token.endswith("</w>")
        self._reset()

    def _reset(self) -> None:
        self.slot: dict[str, int] = {"": 0}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.ends = np.zeros(1 << 14, dtype=np.int64)  # slot i holds flat[ends[i] : ends[i + 1]]
        self.n = 1

    def _add(self, words: list[str], ids: list[np.ndarray]) -> None:
        lens = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        used = int(self.ends[self.n])
        while len(self.flat) < used + lens.sum():
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.ends) < self.n + len(words) + 2:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        if len(ids):
            joined = np.concatenate(ids)
            self.flat[used : used + len(joined)] = joined
        self.ends[self.n + 1 : self.n + 1 + len(words)] = used + np.cumsum(lens)
        self.slot.update(zip(words, range(self.n, self.n + len(words)), strict=True))
        self.n += len(words)

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tk.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Adds library results for new words. Words of ASCII letters only go in joined groups: each ends in one end-of-word
        id, which cuts the group's ids again; a group whose ends do not add up is encoded word by word."""
        plain = [w for w in words if w.isascii() and w.isalpha()]
        other = [w for w in words if not (w.isascii() and w.isalpha())]
        groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for group, e in zip(groups, self.tk.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=np.uint32)
            cut = np.flatnonzero(self.last[ids]) + 1
            if len(cut) == len(group) and (not len(cut) or cut[-1] == len(ids)):
                self._add(group, np.split(ids, cut[:-1]))
            else:
                other += group
        for i in range(0, len(other), 4096):
            self._add(other[i : i + 4096], self._encode(other[i : i + 4096]))

    def _slots(self, words: list[str]) -> np.ndarray:
        """Two slots a word: its stem's and its closing punctuation's, which only words of ASCII letters part with."""
        if self.n > self.max_words:
            self._reset()
        stems, tails = [], []
        for w in words:
            stem = w.rstrip(_TAIL)
            # other letters may end in a mark once normalised or lowered, and a mark joins the punctuation after it
            if stem.isascii() and stem.isalpha():
                stems.append(stem.lower())
                tails.append(w[len(stem) :])
            else:
                stems.append(w)
                tails.append("")
        slot = self.slot
        new = list(dict.fromkeys(w for w in (*stems, *tails) if w not in slot))
        if new:
            self._learn(new)
        out = np.empty((len(words), 2), dtype=np.int64)
        out[:, 0] = np.fromiter(map(slot.__getitem__, stems), dtype=np.int64, count=len(words))
        out[:, 1] = np.fromiter(map(slot.__getitem__, tails), dtype=np.int64, count=len(words))
        return out

    def _batch(self, texts: pa.Array, want_ids: bool) -> tuple[np.ndarray, np.ndarray]:
        offsets, words, codes = pieces_of(texts)
        slots = self._slots(words)
        lens = self.ends[slots + 1] - self.ends[slots]
        counts = segment_sums(lens.sum(axis=1)[codes], offsets)
        if not want_ids:
            return counts, self.flat[:0]
        both = slots[codes].ravel()
        return counts, ragged_take(self.flat, self.ends[both], lens[codes].ravel())

    def encode(self, texts: pa.Array | pa.ChunkedArray, want_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids per text, all ids joined); batches hold about batch_bytes, a longer text goes part by part."""
        texts = filled(texts)
        counts, ids = [], []
        for at, to in byte_slices(texts, self.batch_bytes):
            part = texts.slice(at, to - at)
            if to - at == 1 and pc.binary_length(part)[0].as_py() > self.batch_bytes:
                n = 0
                for s in segments(part[0].as_py(), self.batch_bytes):
                    c, i = self._batch(pa.array([s]), want_ids)
                    n += int(c[0])
                    ids.append(i)
                counts.append(np.array([n]))
            else:
                c, i = self._batch(part, want_ids)
                counts.append(c)
                ids.append(i)
        if not counts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)
        return np.concatenate(counts), np.concatenate(ids)


_CUT = re.compile("(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")


def _drops_white_space(rules: dict) -> bool:
    """Whether a tokenizers file splits by a pattern of which no match holds white space, and removes the rest."""
    first = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    normalisers = (rules.get("normalizer") or {}).get("normalizers") or []
    known = all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " ") for x in normalisers)
    split = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    # every alternative is letters, a number, other signs than white space, or a contraction
    parts = set(first.get("pattern", {}).get("Regex", " ").split("|"))
    words = parts <= {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d", r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"}
    return bool(split and words and known and not any(re.search(r"\s", t["content"]) for t in rules.get("added_tokens", [])))


def _keeps_space_in_front(rules: dict) -> bool:
    """Whether a tokenizers file is byte-level by its usual pattern: white space only ever begins a piece."""
    pre = rules.get("pre_tokenizer") or {}
    return not rules.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and not pre.get("add_prefix_space") and not any(re.search(r"\s", t["content"]) for t in rules.get("added_tokens", []))


def _lowers_bytes(rules: dict) -> bool:
    """Whether a tokenizers file drops white space and is exactly NFC, white space as spaces, lower case, split, bytes."""
    steps = [x["type"] for x in (rules.get("normalizer") or {}).get("normalizers") or []]
    rest = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[1:]
    as_bytes = len(rest) == 1 and rest[0].get("type") == "ByteLevel" and rest[0].get("use_regex") is False and rest[0].get("add_prefix_space") is False
    return steps == ["NFC", "Replace", "Lowercase"] and as_bytes and _drops_white_space(rules) and not any(t["normalized"] for t in rules.get("added_tokens", []))


_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f]")


def rules_needed(text: str) -> int:
    """0: printable ASCII and its white space, where a byte stands for itself; 1: characters up to U+00FF, which NFC leaves as
    they are; 2: any other."""
    if text.isascii():
        return 1 if _CONTROL.search(text) else 0
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return 2
    return 1


class TextEncoder:
    """ids of whole texts by the library of the file. A cut is a space between two ASCII letters or digits; ``cut`` tells
    whether the part after it keeps the space, drops it, or whether this file has no cut that is known to be safe.

    ``fewer_rules``, for files of a known kind (``_lowers_bytes``): ``tokenizers`` holds the file without NFC, the white
    space rule and bytes, the file without NFC and the white space rule, and the file; ``rules_needed`` chooses by text. No
    piece holds white space, so what stands for it changes no id."""

    def __init__(self, path: str, batch_bytes: int = 1_000_000, part_chars: int = 1_000_000, fewer_rules: bool = False) -> None:
        self.batch_bytes, self.part_chars = batch_bytes, part_chars
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.vocab_size = sp.get_piece_size()
            self.encode_batch = lambda texts: sp.encode(texts, num_threads=1)
            self.count_batch = lambda texts: [len(x) for x in self.encode_batch(texts)]
            # pieces begin with the mark of a space or have none, and a text gets one in front
            alone = not any("\u2581" in sp.id_to_piece(i).lstrip("\u2581") for i in range(self.vocab_size))
            self.cut = "drop" if alone and sp.encode("a b") == sp.encode("a") + sp.encode("b") else None
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            tk = Tokenizer.from_file(path)
            with open(path, encoding="utf-8") as f:
                rules = json.load(f)
            self.vocab_size = tk.get_vocab_size(with_added_tokens=True)
            self.encode_batch = lambda texts: [e.ids for e in tk.encode_batch_fast(texts, add_special_tokens=False)]
            self.count_batch = lambda texts: [len(e) for e in tk.encode_batch_fast(texts, add_special_tokens=False)]
            self.cut = "drop" if _drops_white_space(rules) else "keep" if _keeps_space_in_front(rules) else None
            if fewer_rules and _lowers_bytes(rules):
                lower = rules | {"normalizer": rules["normalizer"]["normalizers"][-1]}
                plain = lower | {"pre_tokenizer": rules["pre_tokenizer"]["pretokenizers"][0]}
                self.tokenizers = [Tokenizer.from_str(json.dumps(plain)), Tokenizer.from_str(json.dumps(lower)), tk]
                self.encode_batch = self._encode_by_rules

    def _encode_by_rules(self, texts: list[str]) -> list[list[int]]:
        rows: list[list[int]] = [[], [], []]
        for i, text in enumerate(texts):
            rows[rules_needed(text)].append(i)
        out: list[list[int]] = [[]] * len(texts)
        for tk, mine in zip(self.tokenizers, rows, strict=True):
            for i, e in zip(mine, tk.encode_batch_fast([texts[i] for i in mine], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def _parts(self, text: str) -> list[str]:
        out, at = [], 0
        while self.cut and len(text) - at > self.part_chars and (found := _CUT.search(text, at + self.part_chars)):
            out.append(text[at : found.start()])
            at = found.start() + (self.cut == "drop")
        return [*out, text[at:]]

    def encode(self, texts: pa.Array | pa.ChunkedArray, want_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids per text, all ids joined, or none)."""
        texts = filled(texts)
        counts, ids = [], []
        for at, to in byte_slices(texts, self.batch_bytes):
            batch = texts.slice(at, to - at).to_pylist()
            if to - at == 1:
                found = [[x for part in self._parts(batch[0]) for x in self.encode_batch([part])[0]]] if want_ids else None
                counts.append(len(found[0]) if want_ids else sum(self.count_batch([part])[0] for part in self._parts(batch[0])))
            elif want_ids:
                found = self.encode_batch(batch)
                counts += map(len, found)
            else:
                counts += self.count_batch(batch)
            if want_ids:
                ids += [np.array(x, dtype=np.uint32) for x in found]
        return np.array(counts, dtype=np.int64), np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32)


@lru_cache(maxsize=4)
def encoder(path: str, words: bool = False, fewer_rules: bool = False, **bounds: int) -> TextEncoder | WordEncoder:
    """One encoder per worker process and vocabulary file, so reused workers keep a memo between tasks. With ``words`` the
    word memo serves files of its kind, within ``bounds`` (max_words, batch_bytes); ``fewer_rules`` is ``TextEncoder``'s."""
    if words and path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            if _drops_white_space(json.load(f)):
                return WordEncoder(path, **bounds)
    return TextEncoder(path, fewer_rules=fewer_rules)
