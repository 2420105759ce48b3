"""BPE encoding and decoding by depth-first traversal of a trie of distinct words.

The tokenizer is a file of the public ``tokenizers`` library whose model is BPE with word ends and
whose pre-tokenizer never crosses white space (``word_bpe_49k.json``).  A text is cut into words; a word's
ids do not depend on its neighbours, so each distinct word is encoded once and texts are put together
from words.  Texts with letters beyond Latin-1, or with a special token's string, are cut at ASCII white space into
pieces, and these go through the library's own normalizer and pre-tokenizer.

How a set of distinct words is encoded.  For a BPE whose merge ranks are the order of learning, two facts
hold: (1) the encoding of a string, cut after any of its tokens, is the encoding of the two parts; (2)
a sequence of tokens is an encoding if and only if each adjacent pair is one.  So the encoding of a prefix
is known from its *last token* alone: the rest is the encoding of a shorter prefix, whose last token must go
together with it.  The words are put into a trie (kept as their sorted order, in which a word shares with
its predecessor the path of their common prefix), the traversal goes depth first and keeps the last token
of each node on the path.  A prefix shared by many words is worked out once; the work is linear in
the number of trie nodes, also for a "word" of a million characters.
"""

from __future__ import annotations

import gc
import json
import os
import re
from functools import lru_cache
from struct import pack as _pack

import numpy as np

#: Characters of text taken at a time; bounds the Python objects alive at once.
CHUNK_CHARS = 2 << 20
#: Distinct words remembered per Python worker; beyond it the memory starts anew (results do not change).
CACHE_WORDS = 300_000
CACHE_PAIRS = 300_000

#: Latin-1 letters are single code points that no normal form changes and whose lower case is one code point.
_LATIN = re.compile("[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: The file's pattern for words, over lower-case Latin-1 letters.
_WORDS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \t\n\r\f\va-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def _byte_symbols() -> list[str]:
    """Byte-level symbols: visible Latin-1 characters stand for themselves, other bytes for 256, 257, ... in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(other)) for b in range(256)]


class LibraryBpe:
    """Encoder and decoder for one tokenizer file: distinct words go through the library, texts are put together from words."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        if model["type"] != "BPE" or not self.end or model.get("byte_fallback") or spec.get("decoder"):
            raise ValueError("needs a BPE file with word ends and no decoder")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        strings = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.n_ids = max(strings) + 1
        self.strings = [strings.get(i, "") for i in range(self.n_ids)]
        self.decimals = [str(i) for i in range(self.n_ids)]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.is_end = np.array([t.endswith(self.end) for t in self.strings])
        self.known: dict[str | bytes, bytes] = {}
        # distinct words are normal, split and in byte-level symbols already
        self.words_only = Tokenizer(self.library.model)
        self.words_only.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.symbols = _byte_symbols()
        self.latin = {c: "".join(self.symbols[b] for b in chr(c).encode()) for c in range(256)}
        self._load(model)

    def _load(self, model: dict) -> None:
        pass

    def encode_latin(self, words: list[str]) -> dict[str, bytes]:
        """Ids, as little-endian 32-bit numbers, of distinct lower-case words; each ends with a token with a word end."""
        out: dict[str, bytes] = {}
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            mapped = " ".join("\n".join(part).translate(self.latin).split(self.symbols[10]))
            ids = np.array(self.words_only.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, "<u4")
            cuts = ((np.flatnonzero(self.is_end[ids]) + 1) * 4).tolist()
            raw = ids.tobytes()
            out.update(zip(part, map(raw.__getitem__, map(slice, [0, *cuts], cuts)), strict=True))
        return out

    def _keys(self, text: str) -> list:
        """A text as keys of the cache: its words (str) or, where letters beyond Latin-1 may compose, pieces (bytes)."""
        if "<|" not in text and (text.isascii() or _LATIN.fullmatch(text)):
            return _WORDS.findall(text.lower())
        raw = text.encode("utf-8", "replace")
        # the strings of special tokens count only as they are written
        return raw.split() if "<|" in text else raw.lower().split()

    def _learn(self, keys) -> None:
        """Encode words and pieces that are not known yet."""
        self.known.update(self.encode_latin([k for k in keys if type(k) is str]))
        for piece in keys:
            if type(piece) is bytes:
                self.known[piece] = np.array(self.library.encode(piece.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_many([text]))

    def encode_many(self, texts):
        """Ids (uint32) of each text; a null text counts as empty, white space gives no ids."""
        held: list[list] = []
        size = 0
        for text in texts:
            held.append(self._keys(text) if text else [])
            size += len(text or "")
            if size >= CHUNK_CHARS:
                yield from self._put_together(held)
                held, size = [], 0
        yield from self._put_together(held)

    def _put_together(self, held: list[list]):
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = set().union(*held).difference(self.known)
        if new:
            self._learn(new)
        look = self.known.__getitem__
        for keys in held:
            yield np.frombuffer(b"".join(map(look, keys)), "<u4")

    def decode(self, ids) -> str:
        """As ``decode(ids, skip_special_tokens=False)`` of the library for a file without a decoder: tokens joined by spaces."""
        return " ".join(map(self.strings.__getitem__, ids))

    def written(self, ids) -> str:
        """Decimal ids joined by spaces."""
        return " ".join(map(self.decimals.__getitem__, ids))


class TrieBpe(LibraryBpe):
    """The same, with distinct words encoded by the trie."""

    def _load(self, model: dict) -> None:
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.parts = {vocab[a + b]: (vocab[a], vocab[b], r) for r, (a, b) in enumerate(merges)}
        if len(self.parts) != len(merges):
            raise ValueError("a token that two merges make has no single history")
        #: token strings read backwards, as nested dicts; "" holds the id and the length in symbols
        self.inner: dict = {}
        self.final: dict = {}
        for token, i in vocab.items():
            ends = token.endswith(self.end) and len(token) > len(self.end)
            own = token[: -len(self.end)] if ends else token
            node = self.final if ends else self.inner
            for c in reversed(own):
                node = node.setdefault(c, {})
            node[""] = (i, len(own))
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.spines_right: dict[int, list] = {}
        self.spines_left: dict[int, list] = {}

    # -- which tokens may stand side by side --

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """From the outermost symbol up to the token itself: (token, rank of the merge that ends its life at that edge)."""
        known = (self.spines_left, self.spines_right)[side].get(token)
        if known is None:
            line, died = [], float("inf")
            at: int | None = token
            while at is not None:
                line.append((at, died))
                made = self.parts.get(at)
                at, died = (made[side], made[2]) if made else (None, 0)
            known = (self.spines_left, self.spines_right)[side][token] = line[::-1]
        return known

    def together(self, a: int, b: int) -> bool:
        """Whether the encoding of the string of a followed by that of b is [a, b].

        Replays the merges at the boundary in order of rank: the right edge of a and the left edge of b grow
        until both are whole; they go together unless the two edges merge with each other before that.
        """
        known = self.pairs.get(a << 32 | b)
        if known is not None:
            return known
        left, right, i, j, ok = self._spine(a, 1), self._spine(b, 0), 0, 0, True
        while True:
            (x, x_dies), (y, y_dies) = left[i], right[j]
            merge = self.rank.get((x, y))
            # of equal merges the leftmost goes first: the one inside a precedes, the one inside b follows
            if merge is not None and merge < x_dies and merge <= y_dies:
                ok = False
                break
            if x_dies == y_dies == float("inf"):
                break
            if x_dies <= y_dies:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[a << 32 | b] = ok
        return ok

    def _whole(self, token: int) -> bool:
        """Whether a token's own string is encoded as that one token."""
        known = self.alone.get(token)
        if known is None:
            made = self.parts.get(token)
            known = True
            if made:
                a, b, r = made
                known = self._whole(a) and self._whole(b) and self._meets(a, b, r)
            self.alone[token] = known
        return known

    def _meets(self, a: int, b: int, r: int) -> bool:
        """Whether the edges of a and b first merge when both are whole."""
        left, right, i, j = self._spine(a, 1), self._spine(b, 0), 0, 0
        while True:
            (x, x_dies), (y, y_dies) = left[i], right[j]
            merge = self.rank.get((x, y))
            if merge is not None and merge < x_dies and merge <= y_dies:
                return x == a and y == b and merge == r
            if x_dies == y_dies == float("inf"):
                return False
            if x_dies <= y_dies:
                i += 1
            else:
                j += 1

    # -- the traversal --

    def encode_words(self, words) -> dict[str, bytes]:
        """Ids, as little-endian 32-bit numbers, of each distinct word (given in byte-level symbols)."""
        out: dict[str, bytes] = {}
        inner, final, pairs, together, whole = self.inner, self.final, self.pairs, self.together, self._whole
        # tokens[d], lengths[d]: last token of the encoding of the first d symbols on the path
        tokens, lengths = [-1], [0]
        previous = ""
        for word in sorted(words):
            size = len(word)
            shared = min(len(previous), size - 1)
            if previous[:shared] != word[:shared]:
                shared = len(os.path.commonprefix([previous, word]))
            del tokens[shared + 1 :], lengths[shared + 1 :]
            for depth in range(shared + 1, size + 1):
                # all tokens that end here, short ones first; the one that goes with what stands before it is the last
                node, at, found = (inner if depth < size else final), depth, []
                while at:
                    at -= 1
                    node = node.get(word[at])
                    if node is None:
                        break
                    if "" in node:
                        found.append(node[""])
                while True:  # a single symbol is a token, so one is found
                    token, length = found.pop()
                    if length == depth:
                        if whole(token):
                            break
                    else:
                        before = tokens[depth - length]
                        fits = pairs.get(before << 32 | token)
                        if fits if fits is not None else together(before, token):
                            break
                tokens.append(token)
                lengths.append(length)
            ids, depth = [], size
            while depth:
                ids.append(tokens[depth])
                depth -= lengths[depth]
            ids.reverse()
            out[word] = _pack(f"<{len(ids)}I", *ids)
            # the last node holds the word's end and belongs to no prefix
            tokens.pop()
            lengths.pop()
            previous = word[:-1]
        return out

    # -- texts --

    def _learn(self, keys) -> None:
        """Encode words and pieces that are not known yet."""
        symbols = {k: k if k.isascii() and k.isprintable() else k.translate(self.latin) for k in keys if type(k) is str}
        pieces: dict[bytes, list[str]] = {}
        for piece in keys:
            if type(piece) is bytes:
                text = piece.decode("utf-8")
                if any(s in text for s in self.specials):
                    self.known[piece] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                else:
                    text = self.library.normalizer.normalize_str(text)
                    pieces[piece] = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        ids = self.encode_words(set(symbols.values()).union(*pieces.values()))
        self.known.update({k: ids[w] for k, w in symbols.items()})
        self.known.update({k: b"".join([ids[w] for w in ws]) for k, ws in pieces.items()})


@lru_cache(maxsize=2)
def encoder(path: str, trie: bool = True) -> LibraryBpe:
    """One encoder per Python worker and file."""
    made = TrieBpe(path) if trie else LibraryBpe(path)
    gc.collect()
    gc.freeze()  # its tables live as long as the worker; later collections need not walk them
    return made


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
