"""Byte-pair encoding as a dynamic program over prefixes.

The encoding of a prefix is fixed by its last token: among the tokens that end at a position there is just
one that may follow the last token of what stands before it. "May follow" depends on the two tokens alone,
so the answers are kept per pair and a prefix costs one step on top of a shorter prefix.
"""

from __future__ import annotations

import json
import unicodedata

import regex

NEVER = 1 << 60
#: Entries kept per worker before a cache starts anew; only speed depends on it.
CACHE = 240_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(0x100):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


class Merges:
    """Vocabulary and merge ranks of a tokenizers .json file with a byte-level BPE model."""

    def __init__(self, source: str) -> None:
        conf = json.loads(source)
        model = conf["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()}
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            whole = self.ids[a + b]
            if whole in self.parts:
                raise ValueError(f"two merges make {a + b!r}: prefixes don't fix an encoding")
            self.rank[whole], self.parts[whole], self.pairs[self.ids[a], self.ids[b]] = r, (self.ids[a], self.ids[b]), r
        self.specials = {t["content"]: t["id"] for t in conf.get("added_tokens") or []}
        self.names |= {i: t for t, i in self.specials.items()}
        self.table = {b: ord(c) for b, c in enumerate(byte_symbols())}
        self.follows: dict[int, bool] = {}
        self.sound: dict[int, bool] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.ends: tuple[dict[str, int], dict[str, int]] = ({}, {})  # every end of a token, without and with the suffix: the token it is, or -1
        for t, i in self.ids.items():
            word_end = bool(self.suffix) and t.endswith(self.suffix)
            bare, ends = t.removesuffix(self.suffix) if word_end else t, self.ends[word_end]
            if bare and self.is_sound(i):
                for k in range(1, len(bare)):
                    ends.setdefault(bare[k:], -1)
                ends[bare] = i
        self.left.clear()
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def symbols(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.table)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that show at one edge of `token` while it is built, each with the rank that hides it."""
        kept = self.left if side == 0 else self.right
        out = kept.get(token)
        if out is None:
            out, hidden = [], NEVER
            node: int | None = token
            while node is not None:
                out.append((node, hidden))
                hidden = self.rank.get(node, -1)
                node = self.parts[node][side] if node in self.parts else None
            kept[token] = out
        return out

    def _apart(self, a: int, b: int, but: tuple[int, int] | None = None) -> bool:
        """No merge across the border of a and b comes before the merges within them."""
        for x, hide_x in self._edge(a, 1):
            for y, hide_y in self._edge(b, 0):
                r = self.pairs.get((x, y))
                if r is not None and r < hide_x and r <= hide_y and (x, y) != but:
                    return False
        return True

    def is_sound(self, token: int) -> bool:
        """Does the text of the token encode to just this token?"""
        out = self.sound.get(token)
        if out is None:
            ab = self.parts.get(token)
            out = self.sound[token] = ab is None or self.is_sound(ab[0]) and self.is_sound(ab[1]) and self._apart(*ab, but=ab)
        return out

    def may_follow(self, a: int, b: int) -> bool:
        """Kept per pair of tokens, so most borders are one lookup."""
        if len(self.follows) > 4 * CACHE:
            self.follows.clear()
        out = self.follows[a << 20 | b] = self._apart(a, b)
        return out

    def last_token(self, s: str, d: int, last: list[int], tail: str = "") -> tuple[int, int]:
        """(id, length) of the token that ends the encoding of s[:d] + tail; last[i] is the id for s[:i]."""
        ends, follows, found, at = self.ends[tail != ""], self.follows, [], d - 1
        while at >= 0:
            t = ends.get(s[at:d])
            if t is None:  # no token ends so
                break
            if t >= 0:
                found.append((t, at))
            at -= 1
        for t, at in reversed(found):
            if not at:
                return t, d
            ok = follows.get(last[at] << 20 | t)
            if ok or ok is None and self.may_follow(last[at], t):
                return t, d - at
        raise ValueError(f"no token ends {s[:d]!r}")

    def segments(self, text: str) -> list[str]:
        """Texts between special strings at even places, special strings at odd ones."""
        return self.special_at.split(text) if self.special_at and any(x in text for x in self.specials) else [text]


class Kept(dict):
    """A bounded cache in two generations: what is asked for again outlives the clearing of the older one."""

    def __init__(self) -> None:
        super().__init__()
        self.old: dict = {}

    def __missing__(self, key):  # None: not known
        out = self.old.get(key)
        if out is not None:
            self.put(key, out)
        return out

    def put(self, key, value) -> None:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[key] = value


def fold(text: str) -> str:
    """NFC, then lower case character by character (no final sigma rule)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()
