"""Plain, slow versions of the operators, written from their contracts."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
INF = 1 << 63


def removed_windows(rows, size=13):
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, INF), INF if d is None else d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        keep = [True] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (INF if d is None else d):
                keep[i : i + size] = [False] * size
        out.append((d, len(w), len(w) - sum(keep), hashlib.sha256(" ".join(x for x, k in zip(w, keep, strict=True) if k).encode()).hexdigest()))
    return out


def removed_bytes(rows, size=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(x[i : i + size] for x in raw for i in range(len(x) - size + 1))
    out = []
    for (d, _), x in zip(rows, raw, strict=True):
        m = np.zeros(len(x) + 1, int)
        for i in range(len(x) - size + 1):
            if seen[x[i : i + size]] > 1:
                m[i] += 1
                m[i + size] -= 1
        gone = np.cumsum(m)[: len(x)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(x), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def near(rows, size=3, percent=85):
    """doc_id, n_shingles, component_id, kept for each row."""
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            where[g].append(k)
    shared = Counter((a, b) for v in where.values() for i, b in enumerate(v) for a in v[:i])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            up[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(least.get(find(k), INF), d)
    return [(d, len(sets[k]), least.get(find(k)), d == least.get(find(k))) for k, (d, _) in enumerate(rows)]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    o = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    o += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m[0].split("."))]
    o += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(z := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(z)]
    o += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return o


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


def same(got, wanted):
    got, wanted = sorted(map(tuple, got), key=key), sorted(map(tuple, wanted), key=key)
    bad = [(g, w) for g, w in zip(got, wanted, strict=False) if g != w]
    assert len(got) == len(wanted) and not bad, bad[:3]


def documents(spark, rows, extra=False):
    """rows: (doc_id, text). With extra, columns whose names the operators use inside."""
    df = spark.createDataFrame([(d, t, "en", "src0", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("rid", "uid", "host", "bucket", "kind", "node", "words", "model", "half", "ranges", "held_out", "rank", "component_id"):
            df = df.withColumn(name, df["doc_id"] * 0)
    return df


def main_text(page):
    """The article of a page whose boilerplate is marked: what stands in <article> without marked adverts, forms, scripts and other such elements."""
    import html

    inner = re.search(r"<article\b[^>]*>(.*)</article>", page or "", re.S)
    if not inner:
        return None
    s = re.sub(r"<!--.*?-->", "", inner[1], flags=re.S)
    s = re.sub(r"<(script|style|form|nav|aside|footer)\b.*?</\1>", "\n\n", s, flags=re.S)
    s = re.sub(r'<(div|section)\b[^>]*class="?(?:ad|comments|share|related)"?[^>]*>.*?</\1>', "\n\n", s, flags=re.S)
    s = re.sub(r"</?(?:p|div|h[1-6]|ul|ol|li|section|blockquote|table|tr|td)\b[^>]*>", "\n\n", s)
    s = re.sub(r"<br\b[^>]*>", " ", s)
    s = html.unescape(re.sub(r"<[^>]*>", "", s))
    return " ".join(s.split())


def overlaps(docs, items, percent=80, least=13, drop=4):
    """(doc_id, item_id) -> tokens of the best stretch: every diagonal, every pair of agreeing places with no gap of more than drop."""
    cut = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").translate(LOW))
    out = {}
    for d, text in docs:
        a = cut(text)
        where = defaultdict(list)
        for k, w in enumerate(a):
            where[w].append(k)
        for i, item in items:
            b = cut(item)
            on = defaultdict(list)
            for k, w in enumerate(b):
                for p in where.get(w, ()):
                    on[p - k].append(p)
            best = 0
            for diagonal, hits in on.items():
                hits.sort()
                if len(b) < least:
                    agree = [h - diagonal for h in hits]
                    if agree[0] == 0 and agree[-1] == len(b) - 1 and 100 * len(hits) >= percent * len(b) and diagonal >= 0 and diagonal + len(b) <= len(a):
                        best = max(best, len(hits))
                    continue
                for x in range(len(hits)):
                    for y in range(x, len(hits)):
                        if y > x and hits[y] - hits[y - 1] > drop + 1:
                            break
                        n, size = y - x + 1, hits[y] - hits[x] + 1
                        if size >= least and 100 * n >= percent * size:
                            best = max(best, n)
            if best:
                out[d, i] = best
    return out


def kept_by_quality(rows):
    """Rows (doc_id, text, source) that pass every rule and whose host passes, from the rules' statement."""
    def fails(text):
        w = WORD.findall(text or "")
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        times = Counter(grams)
        repeated = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        symbols = sum(c in "#*$%&|<>" for c in text or "")
        return len(w) < 10 or 100 * len(repeated) > 20 * len(w) or 10 * symbols > len(w) or 100 * (len(lines) - len(set(lines))) > 50 * len(lines)

    failed = [fails(t) for _, t, _ in rows]
    n, bad = Counter(s for *_, s in rows), Counter(s for (*_, s), f in zip(rows, failed, strict=True) if f)
    mean = sum(bad.values()) / len(rows)
    spread = max(sum(bad[h] ** 2 / n[h] for h in n) / len(rows) - mean**2, 0)
    strength = min(max(mean * (1 - mean) / spread - 1 if spread else 1000, 2), 1000)
    return [r for r, f in zip(rows, failed, strict=True) if not f and (bad[r[2]] + mean * strength) / (n[r[2]] + strength) <= 0.5]


ADDRESS = re.compile(r"(?<![^\W_])(?:https?://|HTTPS?://|Https?://|ftp://|FTP://|Ftp://|mailto:|MAILTO:|Mailto:|www\.|WWW\.|Www\.)[^ \t\n\r\x0b\x0c\"'<>{}|\\^`]*")


def address_spans(text):
    out = []
    for m in ADDRESS.finditer(text):
        end = m.end() - len(m[0]) + len(m[0].rstrip(".,;:!?)]"))
        host = text[m.start() + len(re.match(r"(?i)https?://|ftp://|mailto:|www\.", m[0])[0]) : end]
        if re.search(r"[.@]", host):
            out.append(("url", m.start(), end))
    return out


TOLD = re.compile(r"(?<![^\W_])(?:" + "|".join(f"{c}|{c.upper()}|{c.capitalize()}" for c in ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "private_key")) + r")[\"']? {0,2}(?:=>?|:) {0,2}[\"']?([A-Za-z0-9+/=_.-]{16,4096})(?![A-Za-z0-9])")


def secret_spans(text):
    return [("secret", *m.span(1)) for m in TOLD.finditer(text) if re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1])]


def redacted(text, more=()):
    """Spans replaced by their kinds; overlapping ones are one, named by the first, then the longest."""
    out, at, merged = "", 0, []
    for s, e, k in sorted(((s, -e, k) for k, s, e in [*base_spans(text), *address_spans(text), *secret_spans(text), *more])):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], -e)
        else:
            merged.append([s, -e, k])
    for s, e, k in merged:
        out, at = out + text[at:s] + f"[{k.upper()}]", e
    return out + text[at:]
