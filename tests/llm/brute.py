"""Plain Python versions of the contracts, used as oracles."""

import collections
import hashlib
import re
import string
import zlib

import xxhash

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WHITE = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW)) if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(docs):
    where = collections.defaultdict(set)
    key = lambda line: line.strip(WHITE).translate(LOW)
    for i, text in docs:
        for line in (text or "").split("\n"):
            where[key(line)].add(-1 if i is None else i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(where[key(x)]) < 3 or max(where[key(x)]) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def fingerprint(text):
    split = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if w]
    grams = [" ".join(split[j : j + 3]) for j in range(max(1, len(split) - 2))] if split else []
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def components(ids, prints, radius):
    parent = {i: i for i in range(len(ids))}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def contamination(docs, items, n=10):
    table = collections.defaultdict(set)
    for i, text in items:
        w = words(text)
        k = min(n, len(w))
        for j in range(len(w) - k + 1):
            if k:
                table[tuple(w[j : j + k])].add(str(i))
    out = []
    for i, text in docs:
        w, hit, seen = words(text), set(), set()
        for k in {len(g) for g in table}:
            for j in range(len(w) - k + 1):
                if found := table.get(tuple(w[j : j + k])):
                    hit |= set(range(j, j + k))
                    seen |= found
        out.append((i, len(w), len(hit), len(seen), sha(",".join(sorted(seen))), bool(hit)))
    return out


def licenses(text):
    w, starts, labels = words(text), [], set()
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        at = [j for j in range(len(w) - len(p) + 1) if w[j : j + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def jump(key, n):
    at, ahead = -1, 0
    while ahead < n:
        at = ahead
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        ahead = int((at + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return at


def media(text):
    raw = (text or "").encode()
    data = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    return len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:])
