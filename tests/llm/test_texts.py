import random

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import leakage, packing, repetition
from ledgerloom.llm.texts import words


def test_words_see_through_writing():
    plain = words("The café's bike lane, near Ward 3.")
    assert words("<p>THE <b>cafe</b>'s[12] bike​ lane — near “Ward” 3</p>") == plain
    assert words("12: The cafÃ©'s bike-lane\n13: near Ward 3!") == plain
    assert words("&quot;The café's bike lane&quot; near Ward 3") == plain
    assert words(None) == [] and words("") == [] and words("<p></p>") == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60), st.integers(1, 5), st.integers(1, 5))
def test_winnowing_guarantee(codes, k, w):
    """Any shared run of k+w-1 words shares a fingerprint."""
    a = [f"w{c}" for c in codes]
    run = a[: k + w - 1]
    if len(run) == k + w - 1:
        b = ["x1", "x2", *run, "x3"]
        ha, hb = leakage.grams(a, k), leakage.grams(b, k)
        assert {ha[i] for i in leakage.winnow(ha, w)} & {hb[i] for i in leakage.winnow(hb, w)}


def test_grams_depend_on_content_only():
    a, b = "a b c d e".split(), "z z b c d z".split()
    assert leakage.grams(a, 3)[1] == leakage.grams(b, 3)[2] and len(leakage.grams(a, 6)) == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(9, 45), st.integers(0, 10**6))
def test_least_hits_is_a_lower_bound(n, seed):
    """Any admissible leak shares at least that many fingerprints on its own alignment."""
    rng = random.Random(seed)
    item = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    run = leakage.guaranteed_run(n)
    k = min(4, run)
    w = run - k + 1
    size = min(n, leakage.SPAN)
    part = list(item[:size])
    for at in rng.sample(range(size), size // leakage.ONE_IN):
        part[at] = "zzz"
    doc = ["a", "b", *part, "c"]
    hi, hd = leakage.grams(item, k), leakage.grams(doc, k)
    on_item = {(hi[q], q + 2) for q in leakage.winnow(hi, w)}
    hits = on_item & {(hd[p], p) for p in leakage.winnow(hd, w)}
    assert len(hits) >= leakage.least_hits(n, k, w)


def _leaks(doc, item):
    """Brute force over all alignments and stretches."""
    least = min(leakage.SPAN, len(item))
    for shift in range(-len(item), len(doc)):
        for i in range(len(item)):
            for j in range(i + least, len(item) + 1):
                pairs = [(item[q], doc[q + shift]) for q in range(i, j) if 0 <= q + shift < len(doc)]
                if len(pairs) == j - i and sum(x != y for x, y in pairs) * leakage.ONE_IN <= j - i:
                    return True
    return False


def test_leaks_equal_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    items = {i: [rng.choice(vocabulary) for _ in range(rng.choice((9, 14, 18, 26, 40)))] for i in range(1, 13)}
    docs = {}
    for d in range(1, 61):
        text = [rng.choice(vocabulary) for _ in range(30)]
        own = list(items[rng.randrange(1, 13)])
        part = own[rng.randrange(0, 6) :]
        for _ in range(rng.randrange(0, 5)):
            part[rng.randrange(len(part))] = "zzz"
        docs[d] = text[:10] + part + text[10:]
    doc_df = spark.createDataFrame([(d, " ".join(t).upper()) for d, t in docs.items()], "doc_id long, text string")
    item_df = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    got = {tuple(r) for r in leakage.leaks(doc_df, item_df).collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if _leaks(t, x)}
    assert got == want and 10 < len(want) < 60


def test_openings_and_edges(spark):
    opening = "you are given one short record and must choose the best statement"
    few = spark.createDataFrame([(i, f"{opening} {x}") for i, x in enumerate(("alpha " * 30, "beta gamma " * 15, "delta " * 30))], "item_id long, text string")
    assert all("choose" not in r["w"] and len(r["w"]) == 30 for r in leakage.item_words(few).collect())
    two = few.where("item_id < 2")
    assert all("choose" in r["w"] for r in leakage.item_words(two).collect())
    docs = spark.createDataFrame([(1, opening + " and more words here that fill the line up to the end of it all"), (2, None), (3, ""), (None, "x"), (4, "one two three"), (4, "one two three")], "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS p", "3 AS item_id")
    item_df = spark.createDataFrame([(i, f"{opening} {x}") for i, x in enumerate(("alpha " * 30, "beta gamma " * 15, "delta " * 30))] + [(9, None), (10, ""), (11, "one two three")], "item_id long, text string")
    assert {tuple(r) for r in leakage.leaks(docs, item_df).collect()} == {(4, 11)}
    twice = item_df.unionByName(spark.createDataFrame([(11, "four five six seven")], "item_id long, text string"))
    more = docs.unionByName(spark.createDataFrame([(5, "so four five six seven it is")], "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS p", "3 AS item_id"))
    assert {tuple(r) for r in leakage.leaks(more, twice).collect()} == {(4, 11), (5, 11)}
    assert leakage.leaks(docs.limit(0), item_df).count() == 0
    assert leakage.leaks(docs, item_df.limit(0)).count() == 0


def _share(w, k=8):
    marked = set()
    for i in range(len(w) - k + 1):
        if any(w[j : j + k] == w[i : i + k] for j in range(i)):
            marked.update(range(i, i + k))
    return len(marked) / len(w) if w else 0.0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_repeated_share_equals_brute_force(letters):
    assert abs(repetition.repeated_share(letters) - _share(letters)) < 1e-12


def test_repetitive_documents(spark):
    line = "staff endorsed board minutes summarised the parking structure and filed form"
    numbered = "\n".join(f"{i}: {line.upper() if i % 2 else line}!" for i in range(1, 6))
    once = " ".join(f"word{i}" for i in range(400))
    rows = [(1, numbered), (2, once), (3, once + " " + line + " " + line), (4, None), (5, ""), (6, "ok now " * 60), (7, "x" * 200_000), (None, numbered), (1, numbered), (8, (line + ". ") * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k", "2 AS t", "3 AS repeated")
    assert {r[0] for r in repetition.repetitive(df).collect()} == {1, 6, 8}
    assert repetition.repetitive(df.limit(0)).count() == 0


def test_the_bound_loses_no_document(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        part = [rng.choice(["alpha", "beta", "gamma", "delta", "épsilon", "42"]) + str(rng.randrange(40)) for _ in range(rng.randrange(10, 60))]
        rows.append((i, " ".join(part + part[: rng.randrange(len(part))] + [f"u{j}" for j in range(rng.randrange(60))])))
    got = {r[0] for r in repetition.repetitive(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i for i, t in rows if _share(words(t)) >= 0.3} and got


def test_every_document_has_a_share(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(0, 40)))) for i in range(60)] + [(90, None), (91, "x " * 9), (91, "y")]
    got = {r["doc_id"]: r["repeated"] for r in repetition.shares(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: _share(words(t)) for i, t in rows[:-1]}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_long_texts_have_the_tokens_of_one_call():
    encode, _ = repetition.tokenizer(repetition.VOCABULARY)
    rng = random.Random(2)
    text = "".join(rng.choice(["word ", "two  spaces", "\n", "3 4", "é.", " x", "don't ", "\t"]) for _ in range(4000))
    for step in (1, 7, 50, 1000):
        assert repetition.encode_whole(encode, text, step) == encode(text)


def test_tags_notes_and_line_numbers_of_any_length():
    assert words("a <b " + "x" * 900 + ">c</b> [" + "1" * 9 + "] d") == ["a", "c", "d"]
    assert words("1 < 2 and 3 > 2") == ["1", "2", "and", "3", "2"] and words("12345678: a b") == ["a", "b"]


def test_fertility_bands(spark):
    rows = [(i, f"The council approved {i} grants in March.", "en") for i in range(400)] + [(900, "߷߸߹" * 40, "EN"), (901, None, None), (902, "", "fr")]
    got = {r["doc_id"]: r for r in repetition.fertility_bands(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[900]["rejected"] and got[900]["fallback_share"] > 0.3 and not got[5]["rejected"] and got[901]["rejected"]


def test_packing_round_trip(spark):
    rng = random.Random(5)
    rows = [(i, "grant " * rng.choice((1, 30, 200, 700, 1100, 3000))) for i in range(200)] + [(500, None), (501, ""), (None, "x"), (7, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS size", "2 AS piece", "3 AS nth")
    counts = {r[0]: r[1] for r in packing.sizes_by_id(df).collect()}
    got = packing.pack(df).collect()
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["container_id"], []).append(r)
    assert set(by_doc) == {i for i, n in counts.items() if n}
    for d, parts in by_doc.items():
        parts.sort(key=lambda r: r["piece"])
        assert sum(r["size"] for r in parts) == counts[d] and [r["start"] for r in parts] == [2048 * k for k in range(len(parts))]
        assert len(parts) == -(-counts[d] // 2048)
    for parts in by_bin.values():
        parts.sort(key=lambda r: r["at"])
        ends = [0] + [r["at"] + r["size"] for r in parts]
        assert all(r["at"] == e for r, e in zip(parts, ends)) and ends[-1] <= 2048
    assert packing.fill(packing.pack(df)).first()["fill"] > 0.93 > packing.fill(packing.pack_harmonic(df)).first()["fill"]
    assert packing.pack(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 30), max_size=20))
def test_plan_uses_every_item_once(histogram):
    used = {}
    for times, makeup in packing.plan(histogram, 100):
        assert sum(s * j for s, j in makeup) <= 100
        for s, j in makeup:
            used[s] = used.get(s, 0) + j * times
    assert used == histogram
