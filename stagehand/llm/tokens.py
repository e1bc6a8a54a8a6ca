"""Tokenizers by path: ids of texts, and the bytes that each id stands for."""
from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

Encode = Callable[[list[str]], list[list[int]]]

#: ``tiktoken``'s pattern engine gives up on runs of about a million blanks; such texts go to ``tokenizers``.
_LONG_BLANKS = 50_000
_BLANK_RUN = re.compile(rf"\s{{{_LONG_BLANKS}}}")

_LOADED: dict[tuple[str, bool], Encode] = {}


def encoder(path: str, plain: bool = False) -> Encode:
    """``texts -> list of id lists`` for a ``tokenizers`` file, without added special tokens.

    ``plain``: the strings of special tokens inside a text are ordinary text.
    A byte-level BPE file whose merges are in id order is run by ``tiktoken`` on
    the vocabulary of that same file (about four times as fast; the tests hold
    the ids against ``tokenizers``); any other file, and any text with a run of
    50,000 blanks or line breaks, is run by ``tokenizers``.
    """
    if (path, plain) not in _LOADED:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _LOADED[path, plain] = _byte_bpe(spec, path, plain) or _by_tokenizers(path, plain)
    return _LOADED[path, plain]


def _by_tokenizers(path: str, plain: bool) -> Encode:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = plain
    return lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in printable}
    return to_byte | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}


def _byte_bpe(spec: dict, path: str, plain: bool) -> Encode | None:
    import public_tokenizers
    import tiktoken

    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    if (spec.get("normalizer") or model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
            or not pre.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges")):
        return None
    to_byte = _byte_of()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] != t.get("normalized", False)
           for t in spec.get("added_tokens", [])):
        return None
    ranks = {bytes(to_byte[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
    merged = [ranks.get(bytes(to_byte[c] for c in "".join(m if isinstance(m, list) else m.split(" "))))
              for m in model["merges"]]
    if None in merged or merged != sorted(merged):
        return None
    enc = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    slow: list[Encode] = []

    def run(texts: list[str]) -> list[list[int]]:
        out = []
        for t in texts:
            if len(t) >= _LONG_BLANKS and _BLANK_RUN.search(t):
                if not slow:
                    slow.append(_by_tokenizers(path, plain))
                out += slow[0]([t])
            else:
                out.append(enc.encode_ordinary(t) if plain else enc.encode(t, allowed_special="all"))
        return out

    return run


def byte_vocabulary(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level ``tokenizers`` file (a special token: its UTF-8)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    to_byte = _byte_of()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    by_id = {i: bytes(to_byte[c] for c in w) for w, i in spec["model"]["vocab"].items() if w not in special}
    by_id |= {i: w.encode() for w, i in special.items()}
    return [by_id.get(i, b"") for i in range(max(by_id) + 1)]


#: A single blank between two characters that are no blanks: no piece reaches over it from the left.
_CUT = re.compile(r" (?=[^\s▁])(?<=[^\s▁] )")


class Pieces:
    """A ``sentencepiece`` model: ids of texts (``encode``), bytes of ids (``bytes``).

    The model's own search holds some hundred bytes a character, so a very long
    text is cut at single blanks and encoded part by part: with no piece that
    has a blank after another character (looked up here; a model that has one
    gets whole texts) the ids are the same.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(names)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in names) and self.model.encode("a b") == [
            *self.model.encode("a"), *self.model.encode("b")]

    def _parts(self, text: str, size: int) -> Iterator[str]:
        start = 0
        while len(text) - start > size and (cut := _CUT.search(text, start + size)):
            yield text[start:cut.start()]
            start = cut.end()  # the blank comes back as the blank that the model sets before a text
        yield text[start:]

    def encode(self, texts: list[str], part_chars: int = 1 << 20) -> list[list[int]]:
        if not self.cuts or max(map(len, texts), default=0) <= part_chars:
            return self.model.encode(texts, num_threads=1)
        return [[i for part in self._parts(t, part_chars) for i in self.model.encode(part)] for t in texts]


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]
