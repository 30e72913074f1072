"""Plain versions of the operators, one document at a time, for small fixtures."""
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

BLANK = r"[^\x20\x09-\x0D]+"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(BLANK, text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def removals(docs, span=13):
    first = {}
    for i, text in docs:
        w = words(text)
        for a in range(len(w) - span + 1 if i is not None else 0):
            g = tuple(w[a:a + span])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, text in docs:
        w, gone = words(text), set()
        for a in range(len(w) - span + 1 if i is not None else 0):
            if first[tuple(w[a:a + span])] < i:
                gone |= set(range(a, a + span))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def decontamination(docs, items):
    windows = defaultdict(set)
    for i, text in items:
        w = plain_words(text)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[a:a + n])].add(str(i))
    out = []
    for i, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                items_ = windows.get(tuple(w[a:a + n]), ())
                if items_:
                    hit |= set(range(a, a + n))
                    found |= items_
        out.append((i, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return out


def quality(text):
    text = text or ""
    w = words(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    grams = Counter(tuple(w[a:a + 3]) for a in range(len(w) - 2))
    again = {k for a in range(len(w) - 2) if grams[tuple(w[a:a + 3])] > 1 for k in range(a, a + 3)}
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(again), failed


def fingerprint(text):
    w = words(low(text))
    if not w:
        return 0
    shingles = [" ".join(w[a:a + 4]) for a in range(max(1, len(w) - 3))]
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def groups(prints, radius=4):
    """Component number of each fingerprint in a list, by comparing all pairs."""
    label = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return label


def near_duplicates(docs):
    prints = [fingerprint(t) for _, t in docs]
    label = groups(prints)
    lowest = {}
    for (i, _), g in zip(docs, label):
        if i is not None:
            lowest[g] = min(lowest.get(g, i), i)
    return [(i, f"{p:016x}", lowest.get(g)) for (i, _), p, g in zip(docs, prints, label)]


def recurring_lines(docs, min_documents=5, alike=14 / 32, agreement=0.7):
    """Per document the numbers of its recurring lines; documents are told apart by the lines they share, counted out."""
    def tokens(line):
        found = [t for t in re.split("[\t\n\x0b\x0c\r ]", line) if t]
        unspaced = len(found) == 1 and re.search("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\uff00-\uffef]", found[0])
        return list(found[0]) if unspaced else found

    def marked(found):
        return ["<*>" if re.search("[0-9]", t) else t for t in found]

    def general(found):
        return tuple(found if all(t == "<*>" for t in marked(found)) else marked(found))

    def leaf(found):
        return (len(found), *(marked(found[:3]) if len(found) > 3 else general(found)))

    lines = [(k, n, leaf(t), general(t)) for k, (_, text) in enumerate(docs) if text is not None
             for n, t in enumerate(map(tokens, text.split("\n"))) if t]
    held = defaultdict(set)
    for k, _, name, _ in lines:
        held[k].add(name)

    def recurs(rows, name):
        apart = []
        for one in {frozenset(held[k] - {name}) for k, *_ in rows}:
            if not any(len(one & two) > alike * len(one | two) or not one | two for two in apart):
                apart.append(one)
        return len(apart) >= min_documents

    def grouped(rows, key):
        out = defaultdict(list)
        for r in rows:
            out[key(r)].append(r)
        return out

    def agrees(found, template):
        return sum(x == y != "<*>" for x, y in zip(found, template)) >= agreement * sum(x != "<*>" for x in found)

    out = defaultdict(set)
    for name, rows in grouped(lines, lambda r: r[2]).items():
        if not recurs(rows, name):
            continue
        votes, template = {(frozenset(held[k] - {name}), t) for k, _, _, t in rows}, []
        for at in range(name[0]):
            token, n = max(Counter(t[at] for _, t in votes).items(), key=lambda x: (x[1], x[0]))
            template.append(token if 2 * n > len(votes) else "<*>")
        follow = [r for r in rows if agrees(r[3], template)]
        own = [t for t, same in grouped(rows, lambda r: r[3]).items() if recurs(same, name)]
        for k, n, _, t in (follow if recurs(follow, name) else []) + [r for r in rows if any(agrees(r[3], t) for t in own)]:
            out[k].add(n)
    return [sorted(out[k]) for k in range(len(docs))]


def base_scores(docs):
    tokens = {i: words(low(t)) + ["\n"] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    total, distinct = sum(counts.values()), len(counts)
    return counts, [(i, held[i], len(t), sum(counts[w] > 0 for w in t), total,
                     sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in t)) for i, t in tokens.items()]


PII = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
       ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def personal(text):
    out = []
    for kind, pattern in PII:
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits[::-1])) % 10 == 0
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and luhn or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def lattice_scores(docs, vocabulary, rounds, prior_uses=100.0, rank_shift=10.0):
    """log10 probability of every text by plain recursion over the boundaries of each word."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    known = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
             if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    order = sorted((p for p in known if not p.startswith("▁▁") and "▁" not in p.lstrip("▁")), key=lambda p: -known[p])
    weight = {p: 1 / (r + rank_shift) for r, p in enumerate(order)}
    weight[None] = 1 / (len(order) + rank_shift)  # all bytes together
    begins = {p: p is not None and p.startswith("▁") for p in weight}

    def adapted(uses, words):
        cost = {}
        for side in (True, False):
            mine = [p for p in weight if begins[p] == side]
            ranks, used = sum(weight[p] for p in mine), sum(uses.get(p, 0.0) for p in mine)
            cost |= {p: (uses.get(p, 0.0) + prior_uses * weight[p] / ranks) / (used + prior_uses) for p in mine}
        stop = (words + 1.0) / (sum(uses.values()) + 2.0)
        return cost, stop, 1 - min(stop, 1 - 1e-9)

    def arcs(word, a, cost, go_on):
        """(end, piece, weight) of every arc that begins at a."""
        for b in range(a + 1, len(word) + 1):
            if word[a:b] in cost:
                yield b, word[a:b], cost[word[a:b]] * (go_on if a else 1.0)
        if word[a] not in cost:
            n = len(word[a].encode())
            yield a + 1, None, (cost[None] / 256) ** n * go_on ** (n - 1) * (go_on if a else 1.0)

    def tables(word, cost, go_on):
        forward, backward = [1.0] + [0.0] * len(word), [0.0] * len(word) + [1.0]
        for a in range(len(word)):
            for b, _, w in arcs(word, a, cost, go_on):
                forward[b] += forward[a] * w
        for a in reversed(range(len(word))):
            backward[a] = sum(w * backward[b] for b, _, w in arcs(word, a, cost, go_on))
        return forward, backward

    tokens = {i: words(low(t)) for i, t in docs}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    counts, ends = Counter(w for i in train for w in tokens[i]), len(train)
    state = adapted({}, 0.0)
    for _ in range(rounds):
        cost, stop, go_on = state
        uses = defaultdict(float)
        for w in counts:
            word = "▁" + w
            forward, backward = tables(word, cost, go_on)
            for a in range(len(word)):
                for b, piece, x in arcs(word, a, cost, go_on):
                    uses[piece] += forward[a] * x * backward[b] / forward[-1]
        state = adapted(uses, len(counts))
    cost, stop, go_on = state
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    share, out = ends / total, {}
    for i, ws in tokens.items():
        out[i] = math.log10((ends + distinct * share) / (total + distinct))
        for w in ws:
            q = tables("▁" + w, cost, go_on)[0][-1] * stop
            out[i] += math.log10((counts[w] + distinct * (1 - share) * q) / (total + distinct))
    return out


def telling_terms(docs, context=25, prior=1.0, threshold=0.85):
    """(doc number, start, end, disclosure) of disclosing terms in distinct (id, text) rows, counted pair by pair."""
    docs = list(dict.fromkeys((i, t or "") for i, t in docs))
    found = [[(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]{3,}", t)] for _, t in docs]
    held, near, every = defaultdict(set), defaultdict(set), Counter()
    for k, (_, text) in enumerate(docs):
        taken = personal(text)
        free = [x for x in found[k] if not any(a < x[1] and x[0] < b for _, a, b in taken)]
        every.update({w for _, _, w in found[k]})
        for kind, a, b in taken:
            value = text[a:b].lower() if kind == "email" else text[a:b] if kind == "ip" else re.sub("[^0-9]", "", text[a:b])
            held[kind, value].add(k)
            before, after = [w for s, _, w in free if s < a], [w for s, _, w in free if s >= b]
            for w in {*before[-context:], *after[:context]}:
                near[kind, value, w].add(k)

    def sketch(k):
        w = docs[k][1].lower().split()
        return min(xxhash.xxh64_intdigest(" ".join(w[i:i + 5])) for i in range(max(1, len(w) - 4)))

    told = {}
    for (kind, value, w), both in near.items():
        rate, sketches = len(held[kind, value]) / len(docs), len({sketch(k) for k in both})
        if rate < 1:
            given = (sketches + prior * rate) / (sketches * every[w] / len(both) + prior)
            told[w] = max(told.get(w, 0), 1 - math.log(given) / math.log(rate))
    return {(*docs[k], a, b, told[w]) for k, words_ in enumerate(found) for a, b, w in words_ if told.get(w, 0) >= threshold
            and not any(s < b and a < e for _, s, e in personal(docs[k][1]))}
