"""Plain re-statements of what the operators compute, for small inputs."""

import hashlib
import math
import re
import struct
import zlib


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def u32(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def crc(raw: bytes) -> int:
    return zlib.crc32(raw)


def jump(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def top_k(vectors, k, scale):
    """[(id, components or None)] -> sorted (query, rank, id, score)."""
    import math
    rows = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in vectors
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asking = {}
    for i, v in rows:
        if i % 20 == 0:
            asking[i] = min(asking.get(i, v), v)
    out = []
    for q, v in asking.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def fingerprint(text: str, shingle: int = 3) -> int:
    import re

    import xxhash
    words = re.findall("[^ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in text))
    if not words:
        return 0
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, radius):
    """Component of each value (the index of its first member), by all pairs."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(values))]


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_pii(text):
    """[(kind, start, end)] of the four base kinds."""
    import re
    out = []
    for kind, pattern in PII:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def iban_ok(text):
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def leak_words(text):
    import re
    return re.findall(r"\w+", text.lower())


def leaks(docs, items, min_words=13, share=0.8, least=5):
    """{(doc, item): (agree, words)} by trying every shift of every item."""
    out = {}
    for d, text in docs:
        doc = leak_words(text or "")
        for i, body in items:
            item = leak_words(body or "")
            if len(item) < least:
                continue
            best = (0, 0)
            for shift in range(-len(item) + 1, len(doc)):
                lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
                agree = [doc[k + shift] == item[k] for k in range(lo, hi)]
                n_agree = sum(agree)
                # the longest stretch with the share, by all stretches
                if n_agree >= share * least - 1e-9:         # no item is shorter
                    for a in range(len(agree)):
                        for b in range(len(agree), a, -1):
                            got = sum(agree[a:b])
                            if got >= share * (b - a) - 1e-9:
                                x, y = a, b
                                while x < y and not agree[x]:
                                    x += 1
                                while y > x and not agree[y - 1]:
                                    y -= 1
                                if y - x >= min_words or got >= share * len(item):
                                    best = max(best, (got, y - x))
                                break
            if best[0]:
                out[d, i] = best
    return out


def noisy_or(logits, bias):
    """1 - (1 - s(bias)) prod(1 - p), p = max(0, s(z) - s(bias)) / (1 - s(bias))."""
    s = lambda z: 1 / (1 + math.exp(-z))
    return 1 - (1 - s(bias)) * math.prod(1 - max(0.0, s(z) - s(bias)) / (1 - s(bias)) for z in logits)


def toxicity_score(text, bias, weights):
    logits = []
    for sentence in re.split("[.!?\n]", text.lower()):
        words = {w for w in re.split(r"[\x00-\x2f\x3a-\x5e\x60\x7b-\x7f]+", sentence) if w}
        logits.append(bias + sum(weights.get(f, 0.0) for w in words
                                 for f in [w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) > n)]))
    return noisy_or(logits, bias)


def common_subsequence(a, b) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


def noticed(words, template, coverage) -> bool:
    """Whether any stretch of twice the template's length covers enough of it."""
    return any(common_subsequence(words[i:i + 2 * len(template)], template) >= coverage * len(template) - 1e-9
               for i in range(len(words)))
