"""Packing, mixing and residue: brute force, exact sums, held-out accuracy."""

import random
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedloom.llm import residue
from feedloom.llm.mixing import mix, shares
from feedloom.llm.packing import _best_pattern, configurations, pack, plan_packing
from feedloom.llm.tokens import TOKENIZERS, VOCABULARY, encoding, token_count

# --- tokens ---


def test_token_counts(spark):
    texts = ["", None, "a", "Héllo wörld 123", "<|endoftext|>", "x" * 20_000, " \n\t" * 50, "日本語"]
    got = {r["i"]: r["n"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", token_count(F.col("t")).alias("n")).collect()}
    enc = encoding(TOKENIZERS, VOCABULARY)
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i] == len(ids) and enc.decode(ids) == (t or "")


# --- packing ---


def unroll(plan, sizes, counts):
    """Contents of every container, by size."""
    held = defaultdict(list)
    placed = Counter()
    for size, lo, hi, base, off, per in plan.runs:
        for i in range(lo, hi):
            held[base + (i - lo + off) // per].append(size)
            placed[size, i] += 1
    assert placed == Counter({(int(s), i): 1 for s, n in zip(sizes, counts) for i in range(n)})
    return held


@given(st.integers(4, 90), st.dictionaries(st.integers(1, 90), st.integers(1, 60), max_size=30), st.integers(1, 12), st.sampled_from([0.05, 1 / 8, 0.5]))
@settings(max_examples=60, deadline=None)
def test_plans_are_whole_and_fit(capacity, wanted, groups, small):
    line = sorted((s, n) for s, n in wanted.items() if s <= capacity)
    sizes, counts = np.array([s for s, _ in line], np.int64), np.array([n for _, n in line], np.int64)
    plan = plan_packing(capacity, sizes, counts, groups, [small])
    held = unroll(plan, sizes, counts)
    assert set(held) == set(range(plan.containers))
    assert all(sum(x) <= capacity for x in held.values())


def test_plan_is_near_the_least():
    r = np.random.default_rng(1)
    for draw in (r.integers(1, 513, 20_000), np.minimum(512, r.lognormal(4.5, 1, 20_000).astype(int) + 1)):
        sizes, counts = np.unique(draw, return_counts=True)
        plan = plan_packing(512, sizes, counts)
        assert plan.containers <= 1.01 * -(-int(draw.sum()) // 512)


def test_three_to_a_container():
    """n lengths of 0.4 and 2n of 0.3 fill n containers, which matching of pairs and best fit don't find."""
    plan = plan_packing(100, np.array([30, 40]), np.array([200, 100]))
    assert plan.containers == 100
    assert all(sorted(x) == [30, 30, 40] for x in unroll(plan, [30, 40], [200, 100]).values())


@given(st.integers(8, 120), st.data())
@settings(max_examples=60, deadline=None)
def test_best_pattern_of_three(capacity, data):
    rows = data.draw(st.lists(st.tuples(st.integers(capacity // 4 + 1, capacity), st.integers(0, 9)), min_size=1, max_size=7))
    sizes, worth = np.array([s for s, _ in rows]), np.array([w / 8 for _, w in rows])
    pattern = _best_pattern(sizes, worth, capacity)
    tries = [c for n in (1, 2, 3) for c in combinations_with_replacement(range(len(rows)), n) if sum(sizes[i] for i in c) <= capacity]
    assert pattern @ sizes <= capacity and pattern @ worth == pytest.approx(max(sum(worth[i] for i in c) for c in tries))


def test_configurations_meet_the_known_optimum():
    # Cutting stock: capacity 10, 3s and 4s and 5s; two 5s, or 3+3+4, fill a container.
    told = configurations(np.array([5, 4, 3]), np.array([20.0, 10.0, 20.0]), 10)
    assert sum(x for _, x in told) == pytest.approx(20)


def test_pack(spark):
    r = random.Random(4)
    rows = [(i, r.choice([1, 5, 64, 65, 128, 129, 300, 1000]) if r.random() < 0.5 else 37) for i in range(400)] + [(900, 0), (901, None), (None, 50), (7, 37)]
    df = spark.createDataFrame(rows, "doc bigint, n bigint").withColumn("container_id", F.lit("mine"))
    packs = spark.createDataFrame([("s", 64), ("m", 128), ("none", None), ("zero", 0)], "pack string, cap bigint")
    got = pack(df, packs, "doc", "n", "pack", "cap", groups=5).collect()
    for name, cap in (("s", 64), ("m", 128)):
        mine = [x for x in got if x["pack"] == name]
        used, parts = Counter(), defaultdict(list)
        for x in mine:
            used[x["container_id"]] += x["tokens"]
            parts[x["doc"]].append((x["piece"], x["first_token"], x["tokens"]))
        assert max(used.values()) <= cap and set(used) == set(range(len(used)))
        want = Counter()
        for d, n in rows:
            want[d] += n or 0
        assert {d: sum(t for *_, t in p) for d, p in parts.items()} == {d: n for d, n in want.items() if n}
        for d, n in rows[:400]:
            if d != 7:
                assert sorted(parts[d]) == [(i, i * cap, min(cap, n - i * cap)) for i in range(-(-n // cap))]
    assert {x["pack"] for x in got} == {"s", "m"}
    assert pack(df.where("n > 5000"), packs, "doc", "n", "pack", "cap").count() == 0
    empty = pack(df, packs.where("cap < 0"), "doc", "n", "pack", "cap")
    assert empty.count() == 0 and empty.columns == ["pack", "container_id", "doc", "piece", "first_token", "tokens"]


# --- mixing ---


def corpus(seed, n=600):
    r = random.Random(seed)
    return [(i, "big" if r.random() < 0.6 else r.choice(["mid", "small", "untargeted", None]), r.choice([None, 0] + list(range(1, 60)))) for i in range(n)]


TARGETS = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 3), ("absent", 0.1, 5), (None, 0.5, 1)]


def tables(spark, rows):
    return spark.createDataFrame(rows, "doc bigint, source string, n bigint").withColumn("draw", F.lit("mine")), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_mix_meets_the_weights(spark):
    rows = corpus(1)
    items, targets = tables(spark, rows)
    draws = mix(items, targets, "doc", "source", "n")
    got = draws.collect()
    used = Counter((x["doc"]) for x in got)
    cap = {s: m for s, _, m in TARGETS}
    src = {d: s for d, s, _ in rows}
    assert all(k <= cap[src[d]] for d, k in used.items())
    assert {x["source"] for x in got} == {"big", "mid", "small"} and all(x["n"] > 0 for x in got)
    total = sum(x["n"] for x in got)
    supply = Counter()
    for d, s, n in rows:
        supply[s] += n or 0
    most = min(supply[s] * m / (w / 0.9) for s, w, m in TARGETS[:3])
    assert most - 180 <= total <= most
    for s, w, _ in TARGETS[:3]:
        assert abs(sum(x["n"] for x in got if x["source"] == s) / total - w / 0.9) < 0.01
    told = {r["source"]: r for r in shares(draws, targets, "source", "n").collect()}
    assert set(told) == {"big", "mid", "small", "absent"} and told["absent"]["tokens"] == 0
    assert sum(r["actual_share"] for r in told.values()) == pytest.approx(1)
    # Rounds come one after the other: nothing is drawn a second time before all of its source is drawn once.
    for s in ("mid", "small"):
        second = [x["virtual_finish"] for x in got if x["source"] == s and x["draw"] == 2]
        if second:
            assert {x["doc"] for x in got if x["source"] == s and x["draw"] == 1} == {d for d, q, n in rows if q == s and n}
            assert min(second) > max(x["virtual_finish"] for x in got if x["source"] == s and x["draw"] == 1)


def test_mix_budgets(spark):
    items, targets = tables(spark, corpus(2))
    small = mix(items, targets, "doc", "source", "n", budget=500)
    assert 440 <= small.agg(F.sum("n")).first()[0] <= 500
    everything = mix(items, targets, "doc", "source", "n", budget=10**9)
    supply = items.where("n > 0").join(targets, "source").agg(F.sum(F.col("n") * F.col("max_repeats"))).first()[0]
    assert everything.agg(F.sum("n")).first()[0] == supply
    assert mix(items.where("n < 0"), targets, "doc", "source", "n").count() == 0
    none = mix(items, targets.where("target_share > 2"), "doc", "source", "n")
    assert none.count() == 0 and shares(none, targets, "source", "n").where("actual_share is not null").count() == 0


# --- residue ---

WORDS = "harbour mill copper linen council flood tower annals people village river stone market roof keeper guild archive path".split()
NAMES = "Belwyn Tormal Ossiver Quinda Lemsor Havorel Nadrin Pelkar".split()
RESIDUE = [
    "{{{population}}}", "${article.name}", "<%= page.title %>", "@@region@@", "%%DATE%%", "__SUMMARY__", "#{title}", "%(author)s", "$CAPTION$", "[insert name here]", "(TODO: date)",
    "Lorem ipsum dolor sit amet, labore ipsum.", "Placeholder copy for layout only.", "Content coming soon.", "Beispieltext, Beispieltext.", "Texte d'exemple, texte d'exemple.",
    "503 Service Unavailable", "HTTP/1.1 404 Not Found The page you asked for could not be found.", "Traceback: KeyError at line 40 in render_page", '{"error": {"code": 500, "message": "Internal Server Error"}}',
    "Please enable JavaScript to continue.", "JavaScript is disabled. Enable it and reload.", "Diese Seite benötigt JavaScript.", "Veuillez activer JavaScript pour continuer.",
]
FINE = [
    'In the novel the closing line reads "503 Service Unavailable" and the hero laughs.', "JavaScript support was added to the catalogue in 1998.", "A field is written <code>{{{name}}}</code> and replaced.",
    "Printers call a block such as ''lorem ipsum dolor sit amet'' greeking.", "Route 404 and the 503 Broadcast Tower share a null value in the survey.", "{{Infobox river | name = | motto = }}", "__NOTOC__", "{{citation needed|date=May 1900}}",
    "&lt;pre&gt;%%DATE%%&lt;/pre&gt; stands for a day.", "#REDIRECT [[Belwyn]]", "ha ha you believed that", "",
]


def prose(r, sentences=4):
    return " ".join(f"The {r.choice(WORDS)} of {r.choice(NAMES)} holds some {r.randrange(900)} {r.choice(WORDS)} and {r.choice(WORDS)}." for _ in range(sentences))


def texts(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        bad = r.random() < 0.3
        extra = r.choice(RESIDUE if bad else FINE)
        if bad and r.random() < 0.3:
            extra = r.choice([extra.upper(), extra.replace("{", "&#123;").replace("<", "&lt;"), extra.replace(" ", "  ")])
        out.append((r.choice([f"{prose(r)}\n\n{extra}\n\n{prose(r)}", f"{extra}\n\n{prose(r, 2)}", f"{prose(r, 2)}\n\n{extra}"]), bad))
    return out


def test_residue_on_held_out_texts():
    """The score alone decides."""
    model = residue.fit([t for t, _ in texts(1, 800)])
    held = texts(2, 500)
    found = list(zip(model.scores([t for t, _ in held]) >= model.cut, [b for _, b in held]))
    right = sum(f and b for f, b in found)
    assert right / sum(b for _, b in found) > 0.95
    assert right / sum(f for f, _ in found) > 0.97


def test_scores_of_a_batch_are_those_of_single_windows():
    model = residue.fit([t for t, _ in texts(1, 200)])

    def brute(text):
        best = float("-inf")
        for p in residue.passages(text):
            w = [model.number.get(x, len(model.weight) - 1) for x in residue.pieces(p)]
            pair = {int(k): v for k, v in zip(model.pair, model.pair_weight)}
            for i in range(len(w)):
                for n in range(1, model.window + 1):
                    if i + n <= len(w) and (n >= 3 or n == len(w)):
                        best = max(best, model.prior + sum(model.weight[x] for x in w[i : i + n]) + sum(pair.get(a * len(model.weight) + b, 0.0) for a, b in zip(w[i : i + n], w[i + 1 : i + n])))
        return best

    some = [t for t, _ in texts(4, 30)] + [None, "", "one", "two words", "{{{x}}}"]
    assert np.allclose(model.scores(some), [brute(t) for t in some])
    assert len(model.scores([])) == 0


def test_pieces_by_words_are_those_of_the_passage():
    for t, _ in texts(5, 40):
        for p in residue.passages(t):
            assert residue.pieces(p) == [residue._kind(x) for x in residue._PIECE.findall(p)]


def test_withheld_patterns_are_found_by_the_classifier(spark, monkeypatch):
    """With a fifth of the patterns at a time kept from the labels, find_residue still finds half of the texts that only they would mark."""
    told = texts(7, 900)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(told)], "doc_id bigint, text string")
    sets = {"ERRORS": residue.ERRORS.split("\n"), "NOTICES": residue.NOTICES.split("\n"), "SLOTS": residue.SLOTS.split("\n"), "INSTRUCTIONS": residue.INSTRUCTIONS.split("\n"), "FILLER": residue.FILLER.split("\n")}
    found_of, held = 0, 0
    for fold in (0, 3):
        kept = {n: "\n".join(p for i, p in enumerate(ls) if i % 5 != fold) for n, ls in sets.items()}
        every = [any(map(residue.is_trusted, residue.passages(t))) for t, _ in told]
        with monkeypatch.context() as m:
            m.setattr(residue, "_SLOT", residue.re.compile(residue._any(kept["SLOTS"].replace("MAGIC__", "(?:" + "|".join(residue.MAGIC) + ")__"))))
            m.setattr(residue, "_LOWER", [residue.plain.compile(residue._any(p)) for p in (kept["INSTRUCTIONS"], residue.EMPTIES.lower(), kept["FILLER"], kept["ERRORS"], kept["NOTICES"])])
            some = [any(map(residue.is_trusted, residue.passages(t))) for t, _ in told]
            model = residue.fit([t for t, _ in told])
            only = [i for i, (a, b) in enumerate(zip(every, some)) if a and not b]
            found = {r[0] for r in residue.residue_scores(df, model).where("found").collect()}
        found_of, held = found_of + sum(i in found for i in only), held + len(only)
        assert sum(i in found for i, (_, bad) in enumerate(told) if not bad) <= 0.01 * len(told)
    assert held > 20 and found_of > 0


def test_sample_of_very_large_tables(spark, monkeypatch):
    """At 10**14 characters the sample's share is still above zero: it is taken of all 64 bits of the hash."""
    df = spark.createDataFrame([(i, "stone mill " * 9) for i in range(3000)], "doc_id bigint, text string")
    got = []
    monkeypatch.setattr(residue, "fit_marked", lambda told: got.append(told))
    plain = residue.total_chars
    for total, most in ((10**14, 0), (10**12, 0), (plain(df, "text"), 3000)):
        monkeypatch.setattr(residue, "total_chars", lambda *_, n=total: n)
        assert residue.sample_below(total, 6_000_000) > -(2**63)
        residue.fit_on(df, fit_chars=6_000_000)
    assert len(got[0]) <= 1 and len(got[2]) == 3000
    assert (residue.sample_below(10**14, 6_000_000) + 2**63) / 2**64 == pytest.approx(6e-8, rel=1e-3)


def test_residue_learns_what_nobody_named():
    """Words met beside trusted ones are recognized without them."""
    r = random.Random(5)
    told = [f"{prose(r)}\n\n502 Bad Gateway our kettle has boiled dry" for _ in range(60)] + [prose(r) for _ in range(300)]
    model = residue.fit(told)
    assert model.score(f"{prose(r)}\n\nour kettle has boiled dry") >= model.cut
    assert model.score(prose(r)) <= 0


def test_find_residue_off_the_phrase_lists(spark):
    """Residue learnt beside trusted marks is found where no trusted mark is, whatever its length."""
    r = random.Random(5)
    for said in ("our kettle has boiled dry", "our kettle has boiled"):
        alone = [f"{prose(r)}\n\n{said}", f"{said}\n\n{prose(r)}"] * 3
        assert not any(residue.is_trusted(p) for t in alone for p in residue.passages(t))
        told = alone + [f"{prose(r)}\n\n502 Bad Gateway {said}" for _ in range(60)] + [prose(r) for _ in range(300)]
        found = {x[0] for x in residue.find_residue(spark.createDataFrame(list(enumerate(told)), "doc_id bigint, text string")).collect()}
        assert found == set(range(66))


def test_sample_without_keys(spark, monkeypatch):
    """Documents without a key are sampled like others, and repeated rows don't exceed the bound."""
    got = []
    monkeypatch.setattr(residue, "fit_marked", lambda told: got.append([x for x in told if x]))
    r = random.Random(6)
    for said in ([prose(r) for _ in range(400)], [prose(r)] * 400):
        df = spark.createDataFrame([(None, t) for t in said], "doc_id bigint, text string")
        residue.fit_on(df, fit_chars=sum(map(len, said)) // 10)
    assert 10 < len(got[0]) < 90 and len(got[1]) < 90


def test_masking():
    assert "■" in "".join(residue.passages('He said "Internal Server Error" twice.'))
    assert "■" in "".join(residue.passages("Le message « Erreur interne du serveur (4). » a été étudié."))
    assert "{{{x}}}" in "".join(residue.passages('Marked as "a coastal {{{x}}} mill and nothing else" there.'))
    assert not any(map(residue.is_trusted, residue.passages("<nowiki>{{{x}}}</nowiki> and &lt;code&gt;${a.b}&lt;/code&gt;")))
    assert any(map(residue.is_trusted, residue.passages("Please\nenable\nJava​Script\nto continue.")))
    assert any(map(residue.is_trusted, residue.passages('{"title": "X", "text": "Bitte aktivieren Sie JavaScript."}')))
    assert any(map(residue.is_trusted, residue.passages("[rÃ©gion Ã  complÃ©ter]")))


def test_filler_beside_other_marks():
    for said in ("(purus felis lacus ornare vitae)", "Purus felis, lacus ornare vitae!", "[purus felis lacus. ornare vitae]"):
        assert residue.is_trusted(said)
    assert not residue.is_trusted("(purus felis lacus ornare)")


def test_find_residue(spark):
    rows = [(i, t) for i, (t, _) in enumerate(texts(3, 200))] + [(900, None), (901, ""), (902, "{{{1}}} " + "stone mill " * 60_000), (903, "<code>"), (5, texts(3, 6)[5][0]), (None, "{{{name}}}")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("mine"))
    got = Counter(r[0] for r in residue.find_residue(df).collect())
    bad = Counter(i for i, (_, b) in enumerate(texts(3, 200)) if b) + Counter([902, None] + ([5] if texts(3, 6)[5][1] else []))
    assert sum((got & bad).values()) >= 0.95 * sum(bad.values()) and got[902] == 1 and got[None] == 1 and not got[900] and not got[901]
    assert sum((got - bad).values()) <= 2
    assert residue.find_residue(df.where("doc_id < 0")).count() == 0
