"""The contracts of the operators in plain Python, over rows in memory."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import public_tokenizers

BLANK = " \t\n\x0b\x0c\r"


def words(text: str | None) -> list[str]:
    out, word = [], ""
    for c in (text or "") + " ":
        if c in BLANK:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, sum(x in lines[:i] for i, x in enumerate(lines)), len(inside), failed


def repeated_bytes(texts: list[str | None], length: int = 400) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(x or "").encode() for x in texts]
    seen: Counter = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def rank_encoding():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_rows(rows: list[tuple], end: int = 0) -> list[tuple]:
    """(doc_id, start, n_tokens, ids_crc32), rows being (doc_id, text)."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        data = b"".join(x.to_bytes(4, "little") for x in ids)
        out.append((doc_id, start, len(ids), zlib.crc32(data)))
        start += len(ids)
    return out


def shingles(text: str | None) -> frozenset:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lowered)
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def near_components(rows: list[tuple]) -> dict:
    """doc_id -> (n_shingles, component_id), rows being (doc_id, text)."""
    sets = {d: shingles(t) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, s in sets.items():
        for b in {b for x in s for b in holders[x] if b > a}:
            common = len(s & sets[b])
            if 100 * common >= 75 * (len(s) + len(sets[b]) - common):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}


def alignment(rows: list[tuple]) -> dict:
    """doc_id -> (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), rows being (doc_id, text), ids distinct."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    a = Tokenizer.from_file(path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    # The printable bytes stand for themselves, the others in order from 256 on.
    signs, extra = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            signs[chr(byte)] = byte
        else:
            signs[chr(extra)], extra = byte, extra + 1
    with open(path, encoding="utf-8") as file:
        names = {i: t for t, i in json.load(file)["model"]["vocab"].items()}

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    groups = {}
    for doc_id, text in rows:
        groups[doc_id] = []
        if not text:
            continue
        whole = " " + text
        sides = [(i, bytes(signs[c] for c in names[i])) for i in a.encode(whole, add_special_tokens=False).ids], [(i, bytes_b(i)) for i in b.encode(text)]
        if any(b"".join(x for _, x in side) != whole.encode() for side in sides):
            continue
        ends = [{0}, {0}]
        for k, side in enumerate(sides):
            for _, x in side:
                ends[k].add(max(ends[k]) + len(x))
        cuts = sorted(ends[0] & ends[1])
        number = {at: k for k, at in enumerate(cuts)}
        both = [([], []) for _ in cuts[1:]]
        for k, side in enumerate(sides):
            at = group = 0
            for i, x in side:
                both[group][k].append(i)
                at += len(x)
                group = number.get(at, group)
        groups[doc_id] = both
    count = Counter(p for both in groups.values() for p in {(x, y) for xs, ys in both for x in xs for y in ys})
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = {}
    for doc_id, both in groups.items():
        links = [(x, y) for xs, ys in both for x in xs for y in ys]
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in both)
        out[doc_id] = (
            sum(len(xs) for xs, _ in both), sum(len(ys) for _, ys in both), len(both), len(links), sum(count[p] == most[p[0]] for p in links),
            sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if both else "",
        )
    return out


def trie(conversations: dict) -> list[tuple]:
    """Node rows of conversations, conv_id -> list of (role, text), as given."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    rows = [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    ]
    return sorted(rows, key=str)


def rebuilt(rows: list[tuple]) -> dict:
    """conv_id -> turns, from rows (conv_id, turn, role, text) whose turns differ."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def copies(rows: list[tuple]) -> list[tuple]:
    """(doc_id, keep_id, group_size, kept, text_sha256), rows being (doc_id, text), ids distinct and not NULL."""
    def plain(text):
        out = ""
        for c in text or "":
            out += " " if c in BLANK and not out.endswith(" ") else "" if c in BLANK else c
        return out

    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[plain(text)].append(doc_id)
    return sorted((d, min(ids), len(ids), d == min(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for d in ids)
