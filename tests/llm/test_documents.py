"""Every operator on documents against its plain version, and the odd cases each of them must take."""
import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.llm import blocks, chat, components, decontaminate, lattice_lm, line_templates, pieces, quality, sanitise, simhash, storage, substrings
from driftmark.llm.queries import QUERIES

from . import brute

SCHEMA = "doc_id bigint, text string, lang string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA)


def odd(spark):
    """Nulls in every column, repeated rows and ids, extra columns named like inner ones."""
    rows = [(None, "a b c d e f g h i j k l m n o", None), (None, None, None), (1, None, "en"), (2, "", "en"), (2, "", "en"),
            (3, "a b c d e f g h i j k l m n o", "xx"), (3, "a b c d e f g h i j k l m n o", "xx"), (3, "other", None), (4, "a b c d e f g h i j k l m n o", "en")]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(k).alias(k) for k in ("id", "text_hash", "block", "part", "words", "row", "fp", "leaf", "lines", "ids", "c0", "kept", "_row", "script", "item", "start")])


def rows_of(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)


def test_removals(spark, texts):
    got = rows_of(substrings.removals(frame(spark, texts), block_bytes=4000), "doc_id", "n_words", "n_removed", "kept_text")
    want = brute.removals(texts)
    assert got == sorted(want, key=repr) and sum(r[2] for r in want) > 200


def test_removals_odd(spark):
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    got = rows_of(substrings.removals(odd(spark)), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == sorted(brute.removals(rows), key=repr)
    assert substrings.removals(odd(spark).limit(0)).count() == 0


def test_repeated_paths_are_cut_where_an_occurrence_leaves(spark):
    line = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(line)), (2, " ".join(line)), (3, "x " + " ".join(line[10:30]) + " y")]
    paths = rows_of(substrings.repeated_paths(substrings.removals(frame(spark, rows))), "source", "start", "edges", "copies")
    assert paths == [(1, 0, 10, 1), (1, 10, 8, 2), (1, 18, 10, 1)]


def test_scores(spark, texts):
    counts, want = brute.base_scores(texts)
    got = {r.doc_id: r for r in lattice_lm.scores(frame(spark, texts), block_bytes=4000).collect()}
    for i, held, n, known, total, base in want:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base) and r.score < 0


def test_score_is_the_sum_over_all_segmentations():
    scores = {"▁a": -1.0, "▁ab": -2.0, "b": -3.0, "▁": -4.0, "a": -5.0, "ab": -6.0, "c": -7.0}
    model = lattice_lm.SubwordLattice(scores)
    ranked = sorted(scores, key=lambda p: -scores[p])
    cost = {p: float(model.cost[ranked.index(p)]) for p in ranked}

    def total(word, first=True):
        if not word:
            return np.exp(model.stop)
        out = sum(np.exp(cost[p] + (0 if first else model.go_on)) * total(word[len(p):], False) for p in cost if word.startswith(p))
        if word[0] not in cost:
            n = len(word[0].encode())
            out += np.exp(n * model.byte + (n - 1) * model.go_on + (0 if first else model.go_on)) * total(word[1:], False)
        return out

    words = ["ab", "abab", "a", "cab", "é", "abé"]
    assert np.exp(model.log_probability(words)) == pytest.approx([total("▁" + w) for w in words])
    before = model.log_probability(["abab"])[0]
    for _ in range(3):
        uses = model.expected(["abab"] * 50)
        model.adapt(uses, 50)
    assert uses.sum() > 50 and model.log_probability(["abab"])[0] > before


def test_scores_are_the_plain_model_whatever_the_layout(spark, monkeypatch):
    rng = random.Random(17)
    lexicon = ["".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(lexicon) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    want = brute.lattice_scores(rows, lattice_lm.VOCABULARY, lattice_lm.ROUNDS)
    one = {r.doc_id: r.score for r in lattice_lm.scores(frame(spark, rows)).collect()}
    assert one == pytest.approx(want, rel=1e-9)
    monkeypatch.setattr(blocks, "PART_BYTES", 150)
    monkeypatch.setattr(lattice_lm, "TRAIN_BYTES", 100)
    monkeypatch.setattr(lattice_lm, "WORDS_BYTES", 100)
    many = {r.doc_id: r.score for r in lattice_lm.scores(frame(spark, rows), block_bytes=300).collect()}
    assert many == pytest.approx(one, rel=1e-12)


def test_scores_odd(spark):
    got = lattice_lm.scores(odd(spark)).collect()
    assert len(got) == 9 and {r.train_tokens for r in got} == {got[0].train_tokens}
    assert all(np.isfinite([r.score, r.base_score]).all() for r in got)
    assert lattice_lm.scores(odd(spark).limit(0)).count() == 0
    held = [i for i in range(300) if brute.zlib.crc32(str(i).encode()) % 7 == 2][:3]
    unseen = lattice_lm.scores(frame(spark, [(i, "some text") for i in held])).collect()
    assert [(r.n_known, r.train_tokens) for r in unseen] == [(0, 0)] * 3


def test_decontamination(spark, texts):
    items = [(k, " ".join(brute.words(texts[k][1])[5:25])) for k in range(5)]
    items += [(11, "Changed!"), (12, ""), (13, None), (14, "a b, c d"), (15, texts[9][1]), (16, " ".join(brute.words(texts[20][1])[3:13]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.decontamination(frame(spark, texts), bench)
    got = rows_of(found, "doc_id", "n_words", "n_hit", "n_items", "items", "contaminated")
    assert got == sorted(brute.decontamination(texts, items), key=repr)
    left = {r.doc_id for r in decontaminate.drop_contaminated(frame(spark, texts), bench).collect()}
    assert left == {r[0] for r in got if not r[5]}
    assert decontaminate.decontamination(frame(spark, texts[:4]), bench.limit(0)).filter("contaminated").count() == 0


def test_decontamination_beyond_the_broadcast_bound(spark, texts, monkeypatch):
    items = [(k, texts[k][1]) for k in range(3)]
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 5)
    found = decontaminate.decontamination(frame(spark, texts), spark.createDataFrame(items, "item_id bigint, text string"))
    assert rows_of(found, "doc_id", "n_hit") == sorted([(r[0], r[2]) for r in brute.decontamination(texts, items)], key=repr)


def test_decontamination_odd(spark):
    bench = spark.createDataFrame([(1, "c d e f g h i j k l m"), (None, "x y")], "item_id bigint, text string").withColumn("words", F.lit(1))
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    got = rows_of(decontaminate.decontamination(odd(spark), bench), "doc_id", "n_words", "n_hit")
    assert got == sorted([(i, n, h) for i, n, h, *_ in brute.decontamination(rows, [(1, "c d e f g h i j k l m")])], key=repr)
    kept = decontaminate.drop_contaminated(odd(spark), bench)
    assert kept.columns == odd(spark).columns and kept.count() == 5


def test_line_templates(spark, texts):
    found = {r.id: sorted(r.lines) for r in line_templates.recurring_lines(frame(spark, texts)).collect()}
    want = brute.recurring_lines(texts)
    assert found == {i: lines for (i, _), lines in zip(texts, want) if lines}
    cut = {r.doc_id: r for r in line_templates.drop_recurring_lines(frame(spark, texts)).collect()}
    # the numbered notice goes although its number differs, copies keep their lines
    assert not any("All rights reserved" in (r.text or "") for r in cut.values())
    assert cut[4].text == texts[3][1] == cut[61].text and sum(r.n_dropped for r in cut.values()) == 8


def test_line_templates_odd(spark):
    got = line_templates.drop_recurring_lines(odd(spark))
    assert got.columns[:-2] == odd(spark).columns and got.count() == 9
    assert rows_of(got, "doc_id", "text") == rows_of(odd(spark), "doc_id", "text")
    assert line_templates.drop_recurring_lines(odd(spark).limit(0)).count() == 0


def test_quality(spark, texts):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    rows = [*texts, (900, "# a | b\n# a | b\n\n # a | b\n<x> & y"), (901, "ж" * 5 + " слово дело" * 40), (902, " " * 3 + " ".join(chr(0xE100 + k) for k in range(90)))]
    got = {r.doc_id: r for r in quality.quality(frame(spark, rows)).collect()}
    for i, text in rows:
        assert tuple(got[i][n] for n in names) == brute.quality(text), i
        assert not (got[i].base_failed and got[i].kept)
    assert got[1].kept and got[902].byte_share > 0.7 and got[902].reason == "short tokens"


def prose_and_noise():
    """Clean texts of two languages, texts of a rare one, and noise that passes the plain rules."""
    rng = random.Random(12)

    def lexicon(parts):
        return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(400)]

    made = {"en": lexicon(["the", "tion", "ing", "work", "over", "land", "er"]), "de": lexicon(["ung", "schaft", "über", "ver", "gen", "lich"]),
            "nl": lexicon(["aan", "heid", "lijk", "ver", "stad"])}
    rows = [(k, lang, " ".join(rng.choice(made[lang]) for _ in range(rng.randint(80, 200))))
            for k, lang in enumerate(["en"] * 150 + ["de"] * 120 + ["nl"] * 20)]

    def word(chars, low, high):
        return "".join(rng.choice(chars) for _ in range(rng.randint(low, high)))

    junk = {"letters": lambda: " ".join(word("abcdefghijklmnopqrstuvwxyz", 4, 9) for _ in range(300)),
            "base64": lambda: " ".join(base64.b64encode(rng.randbytes(45)).decode() for _ in range(60)),
            "punctuation": lambda: " ".join(word(r"""!"#$%&'()*+,-./:;<=>?@[]^_`{|}~""", 2, 8) for _ in range(200)),
            "mojibake": lambda: " ".join(rng.choice(made["de"]) + "üß" for _ in range(150)).encode().decode("latin-1").encode().decode("latin-1"),
            "numbers": lambda: " ".join(str(rng.randint(0, 10**9)) for _ in range(150))}
    noise = [(1000 + k, lang, make()) for k, (make, lang) in enumerate((m, lang) for m in junk.values() for lang in ("en", "de", "nl", None))]
    return rows, noise


def test_bands_reject_noise_and_keep_prose(spark):
    rows, noise = prose_and_noise()
    df = spark.createDataFrame(rows + noise, "doc_id bigint, lang string, text string")
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    assert all(not got[i].base_failed for i, _, _ in rows + noise)
    assert [i for i, _, _ in rows if not got[i].kept] == []
    assert [(i, got[i].chars_per_token, got[i].entropy) for i, _, _ in noise if got[i].kept] == []
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {i for i, _, _ in rows}
    # copies of one text, a third of all rows, do not move a band, nor does the layout
    many = df.unionByName(spark.createDataFrame([(5000 + k, "de", rows[160][2]) for k in range(160)], df.schema)).repartition(13)
    assert {r.doc_id: r.kept for r in quality.quality(many).collect() if r.doc_id < 5000} == {i: r.kept for i, r in got.items()}


def test_bands_are_percentiles(spark):
    rows, noise = prose_and_noise()
    df = spark.createDataFrame(rows + noise, "doc_id bigint, lang string, text string")
    found = quality.quality(df).toPandas().merge(df.select("doc_id", "lang").toPandas()).drop_duplicates(["lang", "n_words", "word_chars", "n_tokens", "entropy"])
    groups = {("language", n): g for n, g in found.groupby("lang")} | {("script", n): g for n, g in found.groupby("script")}
    bands = {(r.by, r["name"]): r for r in quality.bands(quality._measured(df, "text", "lang", quality.VOCABULARY)).collect()}
    assert set(bands) == {k for k, g in groups.items() if len(g) >= quality.MIN_DOCUMENTS} and ("language", "nl") not in bands
    for key, band in bands.items():
        def at(column, tenths, bins):
            values = np.sort(np.floor(groups[key][column].to_numpy() * bins))
            return values[-(-tenths * len(values) // 10) - 1] / bins
        low, mid, high = (at("chars_per_token", t, 200) for t in (1, 5, 9))
        assert band.documents == len(groups[key])
        assert band.fewest_chars == pytest.approx(mid - max(4 * (mid - low), 0.22 * mid)) and band.most_chars == pytest.approx(mid + max(4 * (high - mid), 1.5 * mid))
        low, mid = (at("entropy", t, 1000) for t in (1, 5))
        assert band.least_entropy == pytest.approx(mid - max(4 * (mid - low), 0.25 * mid))


def test_quality_odd(spark):
    got = quality.judged(odd(spark))
    assert got.count() == 9 and got.filter("kept").count() == 0
    assert quality.keep_good(odd(spark)).columns == odd(spark).columns
    assert quality.quality(odd(spark).limit(0)).count() == 0


def test_near_duplicates(spark, texts):
    got = rows_of(simhash.near_duplicates(frame(spark, texts)), "doc_id", "fingerprint", "component_id")
    assert got == sorted(brute.near_duplicates(texts), key=repr)


def test_near_duplicates_odd(spark):
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    got = rows_of(simhash.near_duplicates(odd(spark)), "doc_id", "fingerprint", "component_id")
    assert got == sorted(brute.near_duplicates(rows), key=repr)
    kept = simhash.keep_first(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == len(set(brute.groups([brute.fingerprint(t) for _, t in rows])))
    assert simhash.near_duplicates(odd(spark).limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [4096, 8])
def test_links_connect_all_pairs_within_the_radius(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket)
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(12)]
    prints = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(40)})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    roots = {r.node: r.root for r in components.components(simhash.fingerprint_links(df)).collect()}
    label, names = brute.groups(prints), {}
    for p, g in zip(prints, label):
        signed = p - (1 << 64) if p >> 63 else p
        names.setdefault(g, set()).add(roots.get(signed, signed))
    assert all(len(v) == 1 for v in names.values()) and len({min(v) for v in names.values()}) == len(names)


def test_chain_masks_keep_every_pair_and_the_ring_loses_none():
    rng = random.Random(1)
    masks = [int(m) for m in simhash.chain_masks(4, 12)]
    assert len(masks) == 36
    for _ in range(3000):
        difference = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(not difference & m for m in masks)
        assert simhash.within_ring(np.array([difference], np.uint64), 4, 12)[0]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(200, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{100 + k: 100 for k in range(50)}}


def toy():
    score = {"▁": -5.0, "▁the": -1.0, "the": -2.0, "t": -6.0, "h": -6.0, "e": -6.0, "th": -3.0, "▁▁": -4.0, "é": -7.0}
    ids = {p: 300 + k for k, p in enumerate(score)}
    return pieces.Pieces(score, ids, list(range(256)), 0)


def best(model, text):
    marked, literal = pieces.MARK + text.replace(" ", pieces.MARK), {k + 1 for k, c in enumerate(text) if c == pieces.MARK}
    top = [0.0] + [-np.inf] * len(marked)
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - model.longest), end):
            free = not any(k in literal for k in range(start, end))
            value = model.score.get(marked[start:end]) if free else None
            if value is None and end - start == 1:
                value = model.worst
            if value is not None:
                top[end] = max(top[end], top[start] + value)
    return top[-1] if text else 0.0


def spent(model, ids):
    text, out, k = {i: p for p, i in model.ids.items()}, 0.0, 0
    while k < len(ids):
        if ids[k] in text:
            out, k = out + model.score[text[ids[k]]], k + 1
        else:
            lead = ids[k]
            out, k = out + model.worst, k + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
    return out


@pytest.mark.parametrize("by_word", [True, False])
def test_search_is_best_and_decodes(by_word):
    model, rng = toy(), random.Random(2)
    model.by_word = by_word
    for _ in range(400):
        text = "".join(rng.choice(["the", "t", "h", "e", " ", "  ", "é", "▁", "\n", "日", "😀", "x", "\x00"]) for _ in range(rng.randint(0, 90)))
        ids = model.encode(text).tolist()
        assert model.decode(np.array(ids, np.int32)) == text
        assert spent(model, ids) == pytest.approx(best(model, text))


def test_pieces_round_trip(spark, texts):
    encoded = pieces.encode(frame(spark, texts))
    got = {r.doc_id: r for r in pieces.decode(encoded).collect()}
    assert all(got[i].text == (t or "") and got[i].n_tokens == len(got[i].ids) for i, t in texts)
    assert pieces.encode(odd(spark)).count() == 9 and pieces.encode(odd(spark).limit(0)).count() == 0


def planted():
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abcdefgh") * 3 for _ in range(30))) for k in range(60)]
    for k in range(100, 106):
        own = [" ".join(rng.choice("ijklmnop") * 4 + str(rng.randint(100, 999)) for _ in range(40)) for _ in range(2)]
        rows.append((k, f"{own[0]} zebra{k} Orwellia writes from ann.b@mail.example.org, card 4111 1111 1111 1111, "
                        f"host 10.0.0.{k} and +1 (555) 123-4567 abc abc {own[1]}"))
    for k in range(30):
        rows[k] = (k, rows[k][1] + " abc abc")
    rows[40] = (40, rows[40][1] + " so says Orwellia alone")
    return rows + [(200, "no.one@nowhere 1.2.3.4.5.6.7.8 300.1.1.1 +12 4111111111111112"), (201, None), (202, "")]


def test_personal_data(spark):
    rows = planted()
    got = {r.doc_id: r for r in sanitise.spans(frame(spark, rows)).collect()}
    for i, text in rows:
        assert [tuple(s) for s in got[i].base] == brute.personal(text), i
    said = {text[s.start:s.end].lower() for i, text in rows if text for s in got[i].terms}
    # a name beside one address in six documents is marked wherever it occurs; words found elsewhere stay
    assert "orwellia" in said and "abc" not in said and not any("zebra" in w for w in said)
    assert [rows[40][1][s.start:s.end] for s in got[40].terms] == ["Orwellia"]
    assert not any(got[i].terms for i in range(60) if i != 40)
    want = {(i, a, b): pytest.approx(x) for i, _, a, b, x in brute.telling_terms(rows)}
    assert {(i, s.start, s.end): s.disclosure for i, r in got.items() for s in r.terms} == want
    clean = {r.doc_id: r.text for r in sanitise.sanitised(frame(spark, rows)).collect()}
    assert "@" not in clean[101] and "Orwellia" not in clean[101] and "<CARD>" in clean[101] and clean[5] == rows[5][1]


def test_personal_data_odd(spark):
    assert sanitise.spans(odd(spark)).count() == 9 and sanitise.spans(odd(spark).limit(0)).count() == 0
    copies = [(k, planted()[60][1]) for k in range(8)]
    assert all(not r.terms for r in sanitise.spans(frame(spark, copies)).collect())
    clean = sanitise.sanitised(odd(spark))
    assert clean.count() == 9 and clean.filter("text is null").count() == 0 and sanitise.sanitised(odd(spark).limit(0)).count() == 0


def test_telling_terms_as_counted_pair_by_pair(spark):
    """Single meetings, copies, terms inside other entities and after the context, several entities in a text."""
    rng = random.Random(31)
    rare, rows = [f"rare{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)], []
    for k in range(300):
        words = [rng.choice(rare) if rng.random() < 0.05 else f"common{rng.randint(0, 40)}" for _ in range(rng.randint(20, 120))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            who = rng.randint(0, 25)
            words.insert(rng.randrange(len(words)), rng.choice([f"p{who}@mail.example.org name{who}", f"10.1.1.{who}", f"+1 (555) 123-45{who:02d}"]))
        rows.append((k, " ".join(words)))
    rows += [(300 + k, rows[k // 3][1]) for k in range(60)]
    got = {(r.doc_id, s.start, s.end): s.disclosure for r in sanitise.spans(frame(spark, rows).repartition(5)).collect() for s in r.terms}
    assert got == {(i, a, b): pytest.approx(x) for i, _, a, b, x in brute.telling_terms(rows)} and len(got) > 30


def test_patterns_match_the_plain_ones():
    rng = random.Random(0)
    for _ in range(5000):
        text = "".join(rng.choice(["a", "@", "@", ".", "b-", "1", "25", "256", "+", " ", "(", "4111111111111111", "x@y.z", "1.2.3.4", "\n", "٣"]) for _ in range(rng.randint(0, 18)))
        assert [e[:3] for e in sanitise.entities(text)] == brute.personal(text)
    assert sanitise.entities("a" * 200_000 + "@" + "1" * 200_000) == []


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"start": F.lit(1), "window": F.lit("w")})


def test_chat_is_read_back(spark):
    rng = random.Random(4)
    said = ["</s>[INST] ok [/INST]", "\\l \\s\\ <s>[x] ]", "", None, "word " * 300, "two words", "é\n😀"]
    rows = [(c, k, "system" if k == 0 and c % 2 else ("user", "assistant")[k % 2], rng.choice(said[:3] if k == 0 else said)) for c in range(20) for k in range(rng.randint(1, 12))]
    rows += [(None, None, None, None), (50, 1, "assistant", "same"), (50, 1, "assistant", "same"), (50, None, "tool[", "x")]
    windows = chat.formatted(turns(spark, rows), budget=200, history=50)
    got = {r.conv: r for r in chat.read_back(windows).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted([((-1 if t is None else t), r or "", x or "") for c, t, r, x in rows if c == conv])
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv].n_turns == len(mine) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    whole = windows.collect()
    assert all(r.n_tokens <= 200 or r.over_budget for r in whole) and any(r.n_repeated for r in whole)
    assert all(r.n_turns - r.n_repeated == 1 or not r.over_budget for r in whole)
    # the system turn stands in front of every later window of its conversation
    heads = {}
    for r in sorted(whole, key=lambda r: r.window):
        if r.conv is not None and r.conv % 2 and r.conv < 20:
            assert r.text.startswith("<s>[system]") and heads.setdefault(r.conv, r.text.split("</s>")[0]) == r.text.split("</s>")[0]
    assert chat.formatted(turns(spark, rows).limit(0)).count() == 0


def test_history_is_limited_and_masked(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k} " + "w " * 30) for k in range(20)]
    for r in chat.formatted(turns(spark, rows), budget=200, history=70).collect():
        repeated = r.text.split("</s>")[:r.n_repeated]
        assert len(repeated) <= 2 and len(r.loss) == sum("[assistant]" in t for t in r.text.split("</s>")[r.n_repeated:])


def test_queries_are_registered():
    assert sorted(QUERIES) == sorted(["op1_substrings", "op2_lattice_lm", "op3_chat_windows", "op4_sanitise", "op5_decontamination",
                                      "op6_line_templates", "op7_quality", "op8_revisits", "op9_simhash", "op10_pieces", "op11_licenses", "op12_lexical_search",
                                      "op13_hard_negatives"])


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert storage.shared_folder(spark) == named.rstrip("/")


def test_only_empty_texts(spark):
    df = frame(spark, [(1, ""), (2, None), (3, " \n\t")])
    bench = spark.createDataFrame([(1, ""), (2, None)], "item_id bigint, text string")
    assert rows_of(substrings.removals(df), "n_words", "n_removed", "kept_text") == [(0, 0, "")] * 3
    assert {(r.n_tokens, r.n_known) for r in lattice_lm.scores(df).collect()} == {(1, 1)}
    assert {tuple(r)[1:4] for r in decontaminate.decontamination(df, bench).collect()} == {(0, 0, 0)}
    assert line_templates.drop_recurring_lines(df).count() == 3
    assert quality.quality(df).filter("n_words = 0 and not kept").count() == 3
    assert {r.component_id for r in simhash.near_duplicates(df).collect()} == {1}
    assert {r.doc_id: r.n_tokens for r in pieces.encode(df).collect()}[1] == 0
    assert sanitise.spans(df).filter("size(base) = 0").count() == 3


def test_a_very_long_text_and_a_very_long_word(spark):
    rng = random.Random(1)
    long = " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 9999)}" for _ in range(20_000))
    rows = [(1, long), (2, long[30_000:60_000]), (3, "x" * 20_000)]
    df = frame(spark, rows)
    assert rows_of(substrings.removals(df), "doc_id", "n_words", "n_removed", "kept_text") == sorted(brute.removals(rows), key=repr)
    assert all(np.isfinite(r.score) for r in lattice_lm.scores(df).collect())
    got = {r.doc_id: r for r in pieces.decode(pieces.encode(df)).collect()}
    assert all(got[i].text == t for i, t in rows)
    assert {r.doc_id: r.n_words for r in quality.quality(df).collect()} == {i: len(t.split()) for i, t in rows}
