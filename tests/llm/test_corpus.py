"""The corpus operators: against SQL, against brute force, and on awkward tables."""

import glob
import hashlib
import itertools
import math
import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from probator.llm import anchors, common, components, ctw, decontaminate, lz_dedup, mixing, ngram_join, pii, quality, queries, suffix_dedup, token_counts, urls

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, segment int, spans int, kind string"


def frame(spark, rows, tmp_path):
    """(id, text, source) rows as a stored table, with columns whose names clash with those the operators use."""
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame([(i, t, "en", s, 0, "x", 1, 2, "k") for i, t, s in rows], SCHEMA).coalesce(2).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


AWKWARD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (4, "one", "b"), (None, "w " * 3000, "b"), (5, "\x00 Zürich 日本 😀 " * 40, None), (6, "a b c d e f g " * 30, "a"), (6, "a b c d e f g " * 30, "a")]
OPERATORS = {
    "rate": quality.rate_documents, "score": ctw.score_documents, "bytes": suffix_dedup.remove_repeats, "words": lz_dedup.remove_passages, "pii": pii.find_pii, "similar": ngram_join.similar_documents,
    "mix": mixing.mix_sources, "tokens": token_counts.count_tokens, "masked": pii.masked_documents,
    "leaks": lambda d: decontaminate.find_contamination(d, d.sparkSession.createDataFrame([(1, "zürich 日本"), (2, None), (None, "one")], "item_id long, text string")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_and_empty_tables(spark, tmp_path, name):
    assert OPERATORS[name](frame(spark, AWKWARD, tmp_path)).count() == len(AWKWARD)
    assert OPERATORS[name](frame(spark, [], tmp_path / "none")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    want = con.execute(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, DATA)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_interval_expansion_finds_what_counting_finds():
    rng = np.random.default_rng(3)
    for _ in range(40):
        parts = [rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 60)).astype(np.uint8) for _ in range(rng.integers(1, 6))]
        parts.append(parts[0][2:].copy() if len(parts[0]) > 3 else parts[0])
        n = int(rng.integers(8, 24))
        seen = Counter(bytes(p[i : i + n]) for p in parts for i in range(len(p) - n + 1))
        for mask, p in zip(suffix_dedup.repeated_windows(parts, n), parts, strict=True):
            assert mask.tolist() == [seen[bytes(p[i : i + n])] > 1 for i in range(len(p) - n + 1)]


def texts(rng, n, size, words=5):
    return [" ".join(rng.choice([f"w{i}" for i in range(words)], rng.integers(0, size))) for _ in range(n)]


@pytest.mark.parametrize("hot", [4000, 1])
def test_repeats_match_brute_force(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(anchors, "HOT", hot)
    rng = np.random.default_rng(5)
    docs = [(i, t, "a") for i, t in enumerate(texts(rng, 30, 90))]
    got = {r.doc_id: r for r in lz_dedup.remove_passages(frame(spark, docs, tmp_path), width=6, gram=2).collect()}
    seen = set()
    for i, t, _ in docs:
        w, gone = t.split(), set()
        for k in range(len(w) - 5):
            if tuple(w[k : k + 6]) in seen:
                gone.update(range(k, k + 6))
            seen.add(tuple(w[k : k + 6]))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, docs, tmp_path), length=20, gram=6).collect()}
    count = Counter(t.encode()[k : k + 20] for _, t, _ in docs for k in range(len(t) - 19))
    for i, t, _ in docs:
        gone = {k + j for k in range(len(t) - 19) if count[t.encode()[k : k + 20]] > 1 for j in range(20)}
        assert (got[i].n_removed, got[i].kept_sha256) == (len(gone), hashlib.sha256(bytes(b for k, b in enumerate(t.encode()) if k not in gone)).hexdigest())


@pytest.mark.parametrize(("costly", "full"), [(4, 256), (1, 4), (0, 0)])
def test_similar_documents_match_brute_force(spark, tmp_path, monkeypatch, costly, full):
    monkeypatch.setattr(ngram_join, "COSTLY", costly)
    monkeypatch.setattr(ngram_join, "FULL", full)
    rng = np.random.default_rng(7)
    base = [[f"v{rng.integers(60)}" for _ in range(60)] for _ in range(4)]
    docs = []
    for i in range(60):
        w = list(base[i % 4])
        for _ in range(rng.integers(0, 5)):
            w[rng.integers(60)] = f"x{rng.integers(1000)}"
        docs.append((i, " ".join(w[: rng.integers(40, 61)]), "a"))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t, _ in docs}
    least = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    got = ngram_join.similar_documents(frame(spark, docs, tmp_path)).collect()
    assert {r.doc_id: r.component_id for r in got} == least
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("name", ["score", "bytes", "words", "similar", "mix"])
def test_row_numbers_do_not_depend_on_how_files_are_split(spark, tmp_path, monkeypatch, name):
    """Between two writes of an operator the planner deals out the files otherwise, as it does when executors come or go."""
    words = texts(np.random.default_rng(11), 40, 400, 40)
    docs = frame(spark, [(i % 50, words[i % 40] + " z" * (i > 60), "ab"[i % 2]) for i in range(80)], tmp_path)
    flat = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    want, write, n = flat(OPERATORS[name](docs).collect()), common.passing, [0]

    def passing(df, *more):
        out = write(df, *more)
        n[0] += 1
        spark.conf.set("spark.sql.files.openCostInBytes", ("0", "4m")[n[0] % 2])
        return out

    monkeypatch.setattr(common, "passing", passing)
    try:
        for first in (0, 1):
            n[0] = first
            spark.conf.set("spark.sql.files.openCostInBytes", ("0", "4m")[first])
            assert flat(OPERATORS[name](docs).collect()) == want
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_row_numbers_of_tables_that_are_no_files(spark, tmp_path):
    docs = frame(spark, [(i, "t", "a") for i in range(9)], tmp_path / "a b%")
    assert common.stored_files(docs) and common.numbered(docs, "doc_id").select("_row").distinct().count() == 9
    for other in (docs.union(docs), docs.crossJoin(spark.range(2)), spark.read.parquet(*[str(tmp_path / "a b%" / "docs.parquet")] * 2)):
        rows = common.numbered(other, "doc_id")
        assert rows.count() == rows.select("_row").distinct().count() == 18


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 9), (9, 8), (3, 3), (7, 20), (20, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 8, 7: 7, 20: 7}


def test_context_tree_matches_the_definition(spark, tmp_path):
    rows = [(i, t, "a") for i, t in enumerate(["abab", "abba abab", "Xyz", "", "bab"])]
    depth = 2
    held = {i for i, _, _ in rows if i in (1, 4)}
    counts = defaultdict(lambda: [0, 0])

    def decisions(text):
        data = bytes(depth) + text.lower().encode() + b"\0"
        for k in range(depth, len(data)):
            for b in range(8):
                yield data[k - depth : k], (1 << b) | (data[k] >> (8 - b)), (data[k] >> (7 - b)) & 1

    for i, t, _ in rows:
        if i not in held:
            for context, node, bit in decisions(t):
                for d in range(depth + 1):
                    counts[context[depth - d :], node][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def log_weighted(context, node):
        own = kt(*counts.get((context, node), (0, 0)))
        if len(context) == depth:
            return own
        below = sum(log_weighted(c, n) for c, n in list(counts) if n == node and len(c) == len(context) + 1 and c[1:] == context)
        return np.logaddexp(math.log(0.5) + own, math.log(0.5) + below)

    def predict(context, node, bit):
        p = None
        for d in range(depth, -1, -1):
            c = context[depth - d :]
            n = counts.get((c, node), (0, 0))
            here = (n[bit] + 0.5) / (sum(n) + 1)
            w = 1 if p is None else math.exp(math.log(0.5) + kt(*n) - log_weighted(c, node))
            p = here if p is None else w * here + (1 - w) * p
        return p

    docs = frame(spark, rows, tmp_path)
    got = {r.doc_id: r for r in ctw.score_documents(docs, held_out=docs["doc_id"].isin(1, 4), depth=depth).collect()}
    for i, t, _ in rows:
        assert got[i].score == pytest.approx(sum(math.log10(predict(*x)) for x in decisions(t)), abs=1e-9)
    tokens = Counter(w for i, t, _ in rows if i not in held for w in [*t.lower().split(), None])
    n, v = sum(tokens.values()), len(tokens)
    assert got[1].base_score == pytest.approx(sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in ["abba", "abab", None]))
    assert (got[1].n_tokens, got[1].n_known, got[1].train_tokens, got[1].held_out) == (3, 2, n, True)


#: The patterns of the contract.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    """The base spans, by the patterns as they are."""
    digits = lambda t: "".join(c for c in t if c in "0123456789")
    double = lambda d: sum(int(x) for i, c in enumerate(reversed(d)) for x in str(int(c) * (1 + i % 2)))
    passes = {"email": lambda t: True, "ip": lambda t: all(int(x) <= 255 for x in t.split(".")), "card": lambda t: 12 <= len(digits(t)) <= 19 and double(digits(t)) % 10 == 0, "phone": lambda t: 9 <= len(digits(t)) <= 15}
    found = [(m.start(), kind, m.end()) for kind, pattern in PATTERNS.items() for m in re.finditer(pattern, text) if passes[kind](m[0])]
    return sorted(found, key=lambda s: (s[0], list(PATTERNS).index(s[1])))


def test_base_spans_match_the_patterns(spark, tmp_path):
    rng = np.random.default_rng(21)
    bits = ["a.b", "@", "x-y.org", " ", "10.0.0.1", "256", ".", "+", "1 (555) 010-9999", "4111 1111 1111 1111", "-", "é", "\n", "9", "00", "+49", "@@", "..", "1.2.3.4.5.6.7.8"]
    texts_ = ["".join(rng.choice(bits, rng.integers(1, 30))) for _ in range(300)]
    assert [pii.pattern_spans(t) for t in texts_] == [plain_spans(t) for t in texts_]
    got = {r.doc_id: r for r in queries.op5_pii(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        base = plain_spans(r.text or "")
        assert got[r.doc_id].base_sha256 == hashlib.sha256(pii.spelled(base).encode()).hexdigest()
        assert (got[r.doc_id].n_email, got[r.doc_id].n_ip, got[r.doc_id].n_card, got[r.doc_id].n_phone) == tuple(sum(k == kind for _, k, _ in base) for kind in PATTERNS)
        listed = got[r.doc_id].spans.split(",") if got[r.doc_id].spans else []
        assert {f"{k}:{a}:{b}" for a, k, b in base} <= set(listed)
        assert all(0 <= int(a) < int(b) <= len(r.text) for _, a, b in (x.split(":") for x in listed))


def test_patterns_take_linear_time():
    import time

    began = time.perf_counter()
    for text in ("7" * 1_000_000, "1." * 500_000, "a" * 1_000_000 + "@", "@" * 1_000_000, "+1" + "(" * 1_000_000, "1 " * 500_000):
        pii.pattern_spans(text)
    assert time.perf_counter() - began < 20


#: Runs that no template makes, with their labels: what the field is worth on others' writing.
UNSEEN = [
    ("jo.q@mail.example", "email"), ("<first_last99@uni.ac.example>", "email"), ("r2d2@droids.example;", "email"), ("192.168.10.1/24", "ip"), ("[8.8.4.4]", "ip"), ("172.16.254.3;", "ip"),
    ("5500-0055-5555-5559", "card"), ("4012888888881881", "card"), ("3782 822463 10005", "card"), ("+44 20 7946 0958", "phone"), ("(020) 7946-0018", "phone"), ("+1-202-555-0143", "phone"), ("030.901.8201", "phone"),
    ("1984", "O"), ("12,5", "O"), ("v2.0.1", "O"), ("3rd", "O"), ("50-60", "O"), ("2021-03-04T10:11", "O"), ("x86", "O"), ("£1,200.50", "O"), ("#17", "O"), ("7:45pm", "O"), ("@handle", "O"),
]


def test_personal_data():
    text = "mail a.b@c.example.org, 10.0.0.256 or 10.0.0.25 card 4111 1111 1111 1111 call +1 (555) 010-9999 now"
    assert [(k, text[a:b]) for a, k, b in pii.pattern_spans(text)] == [("email", "a.b@c.example.org"), ("ip", "10.0.0.25"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 010-9999")]
    field = pii.Field(pii.labelled_runs())
    table = pii.labelled_runs(20, seed=99)
    right = sum([pii.LABELS[k] for k in path] == tags for path, (_, tags) in zip(field.decode([w for w, _ in table]), table, strict=True))
    assert right >= 0.97 * len(table)
    unseen = sum({pii.LABELS[k] for k in path} == {label} for path, (_, label) in zip(field.decode([t.split() for t, _ in UNSEEN]), UNSEEN, strict=True))
    assert unseen >= 0.8 * len(UNSEEN)
    words = "+1 (569) 555-6633 4795326016703902".split()
    assert [pii.LABELS[k] for k in field.decode([words])[0]] == ["phone", "phone", "phone", "card"]
    # Viterbi against all paths from an unlabelled word to an unlabelled word
    run = ["(829)", "555-4386", "2024", "10.1.2.3"]
    score = field.scores(run)
    best = max(itertools.product(range(5), repeat=4), key=lambda p: sum(score[k, x] for k, x in enumerate(p)) + sum(field.step[a, b] for a, b in zip((0, *p), (*p, 0))))
    assert tuple(field.decode([run])[0]) == best
    assert pii.masked("a b@c.de f", [(2, "email", 8)]) == "a [EMAIL] f"


def plain_targets(sizes):
    """Shares by weight, capped at three times the size, the excess shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed = {}
    while True:
        free = [s for s in order if s not in fixed]
        share = {s: (sum(sizes.values()) - sum(fixed.values())) * weight[s] / sum(weight[t] for t in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, None: 50, "c": 0}, {"x": 5}, {"é": 7, "z": 1, "A": 900, "b": 2, "B": 2, None: 1}, {}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(plain_targets(sizes) if sizes else {})


def test_mixing_reaches_targets(spark, tmp_path):
    rng = np.random.default_rng(1)
    docs = [(i, "w " * int(rng.integers(1, 40)), ["a", "b", "c", None][i % 4 if i < 400 else 0]) for i in range(1200)]
    got = mixing.mix_sources(frame(spark, docs, tmp_path)).collect()
    taken, goal = Counter(), {}
    for r in got:
        taken[r.source] += r.copies * r["size"]
        goal[r.source] = r.target
        assert 0 <= r.copies <= 3
    assert goal == pytest.approx(plain_targets(Counter_of(docs)))
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 0.02 * goal[s] + 80
    # The same documents in another order and other files
    other = frame(spark, docs[::-1], tmp_path / "other").repartition(5)
    again = mixing.mix_sources(other).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)


def Counter_of(docs):
    out = Counter()
    for _, t, s in docs:
        out[s] += len((t or "").split())
    return out


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_token_counts_round_trip(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(token_counts, "FILE_TOKENS", 50)
    rows = [(i, t, "a") for i, t in enumerate([*texts(np.random.default_rng(2), 12, 30), "", None])]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame(spark, rows, tmp_path), block_bytes=block).collect()}
    code = token_counts.encoder(token_counts.VOCABULARY)
    assert got == {i: len(code.encode_ordinary(t or "")) for i, t, _ in rows}


def test_contamination_in_slices_and_proximity(spark, tmp_path, monkeypatch):
    rows = [(1, "x a b c d e f y a b c", "a"), (2, "nothing here", "a")]
    items = spark.createDataFrame([(1, "a b c"), (2, "d e f y"), (3, "zzz")], "item_id long, text string")
    whole = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.find_contamination(frame(spark, rows, tmp_path), items, width=3).collect()}
    assert whole == {1: (11, 10, ["1", "2"]), 2: (2, 0, [])}
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 5)
    sliced = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.find_contamination(frame(spark, rows, tmp_path), items, width=3).collect()}
    assert sliced == whole


def test_proximity_matches_brute_force(spark, tmp_path):
    rng = np.random.default_rng(13)
    rows = [(i, t, "a") for i, t in enumerate(texts(rng, 40, 60, 12))]
    items = [(i, " ".join(rng.choice([f"w{k}" for k in range(12)], n))) for i, n in enumerate((3, 4, 4, 2, 6))]
    count = Counter(w for _, t, _ in rows for w in t.split())
    got = {r.doc_id: r for r in decontaminate.find_contamination(frame(spark, rows, tmp_path), spark.createDataFrame(items, "item_id long, text string"), width=4, distance=3).collect()}
    for i, t, _ in rows:
        w, near, exact = t.split(), set(), set()
        for item, phrase in items:
            p = phrase.split()
            for win in ([tuple(p[k : k + 4]) for k in range(max(1, len(p) - 3))]):
                exact |= {str(item)} if any(tuple(w[k : k + len(win)]) == win for k in range(len(w) - len(win) + 1)) else set()
                rarest = min(win, key=lambda x: count[x])
                if any(w[k] == rarest and all(x in w[max(0, k - 3) : k + 4] for x in win) for k in range(len(w))):
                    near.add(str(item))
        assert (set(got[i]["items"]), set(got[i].near_items)) == (exact, near)


def test_urls(spark):
    pages = spark.createDataFrame([(1, "HTTP://A.Example.NET/en/x?q"), (2, "http://b.net/x"), (3, "no scheme"), (4, None), (5, "http://c.org/fr/#z"), (6, "http://bad.com/"), (7, "http://net")], "page_id long, url string")
    labels = spark.createDataFrame([(6, 0), (5, 1), (2, None)], "doc_id long, quality int")
    got = {r.page_id: tuple(r)[1:5] for r in urls.filter_urls(pages, labels).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2][2:] == ("net/", "block") and got[5][2:] == ("org/fr/", "allow")
    assert got[3][:3] == got[4][:3] == ("", "", None) and got[7][:3] == ("net", "", None)
    assert urls.filter_urls(pages.limit(0), labels).count() == 0 and urls.filter_urls(pages, labels.limit(0)).count() == 7


def test_reputation_by_site(spark):
    hosts = ["a.b.example.co.uk", "example.co.uk", "co.uk", "u:p@www.site.com:8080", "10.1.2.3", "x.10.1.2.3", "localhost", "", "name.io.", "com.au"]
    got = {r.h: (r.s, r.x, r.d) for r in spark.createDataFrame([(h,) for h in hosts], "h string").withColumn("s", urls.site_of(F.col("h"))).withColumn("x", urls.site_suffix(F.col("s"))).withColumn("d", urls.site_domain(F.col("s"), F.col("x"))).collect()}
    assert got["a.b.example.co.uk"][1:] == got["example.co.uk"][1:] == ("co.uk", "example.co.uk") and got["co.uk"][1:] == ("co.uk", "co.uk") == ("co.uk", got["co.uk"][2])
    assert got["u:p@www.site.com:8080"] == ("www.site.com", "com", "site.com") and got["10.1.2.3"] == ("10.1.2.3",) * 3 and got["localhost"] == ("localhost",) * 3 and got[""] == ("",) * 3 and got["name.io."] == ("name.io", "io", "name.io")
    # What one company's site did is not held against another that shares its public suffix, and ports share a site.
    pages = spark.createDataFrame([*((i, "http://bad.co.uk/") for i in range(20)), (30, "http://good.co.uk/"), (31, "http://bad.co.uk:81/"), (32, "http://sub.bad.co.uk/"), *((i, f"http://s{i}.co.uk/") for i in range(40, 80))], "page_id long, url string")
    labels = spark.createDataFrame([*((i, 0) for i in range(20)), *((i, 1) for i in range(40, 80))], "doc_id long, quality int")
    verdict = {r.page_id: r.verdict for r in urls.filter_urls(pages, labels).collect()}
    assert (verdict[30], verdict[31], verdict[32]) == ("allow", "block", "block")


def kept_by_quality(text):
    """The quality rules in plain Python: the cleaned text, or None if the document goes."""
    words, lines = (text or "").split(), [x for x in (text or "").split("\n") if x.split()]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeats = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    symbols = lambda s: sum(c in quality.SYMBOLS for c in s)

    def fails(s):
        n = len(s.split())
        end = s.rstrip(" ")[-1:]
        return (end not in quality.ENDS and n < quality.SHORT_LINE) or symbols(s) > quality.SYMBOL_SHARE * n or any(re.search(p, s) for p in (quality.NAVIGATION.partition("|(?i)")[0], "(?i)" + quality.NAVIGATION.partition("(?i)")[2], quality.BOILERPLATE))

    left = sum(len(s.split()) for s in lines if not fails(s))
    if len(words) < 50 or 100 * len(repeats) > 50 * len(words) or len(words) - left > quality.MAX_LOSS * len(words):
        return None
    return "\n".join(s for s in text.split("\n") if not s.split() or not fails(s))


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    """Each stage on what the one before has kept, against plain Python."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)

    def through(name, df):
        path = str(tmp_path / f"{name}.parquet")
        stage[name](spark, df, DATA).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    before = {r.doc_id: r for r in docs.collect()}
    cleaned = through("quality_rules", docs)
    now = {r.doc_id: r.text for r in cleaned.collect()}
    assert now == {i: t for i, r in before.items() if (t := kept_by_quality(r.text)) is not None}
    single = through("ngram_jaccard_join", cleaned)
    sets, least = {i: shingles(t) for i, t in now.items()}, {i: i for i in now}
    links = [(i, j) for i, j in itertools.combinations(sorted(now), 2) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) > 0]
    for _ in links:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i in now if least[i] == i)
    leaks = {r.doc_id for r in queries.op9_decontamination(spark, str(_folder(spark, tmp_path, single))).where("contaminated").collect()}
    clean = through("decontamination", single)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i in now if least[i] == i and i not in leaks)
    masked = through("pii", clean)
    got = {r.doc_id: (r.text, r.n_chars) for r in masked.collect()}
    assert set(got) == {r.doc_id for r in clean.collect()}
    for i, (text, n) in got.items():
        assert n == len(text) and not plain_spans(text) and (plain_spans(now[i]) or text.count("[") >= now[i].count("["))
    mixed = through("mix_sources", masked).collect()
    source = {r.doc_id: r.source for r in masked.collect()}
    sizes, taken = Counter(), Counter()
    for i, (text, _) in got.items():
        sizes[source[i]] += len(text.split())
    goal = plain_targets(sizes)
    for r in mixed:
        taken[r.source] += len(r.text.split())
        assert r.target == pytest.approx(goal[r.source]) and 1 <= r.copy <= 3 and r.text == got[r.doc_id][0]
    for s in goal:
        assert abs(taken[s] - goal[s]) <= max(len(t.split()) for t, _ in got.values())


def _folder(spark, tmp_path, docs):
    folder = tmp_path / "sf"
    docs.write.mode("overwrite").parquet(str(folder / "documents.parquet"))
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.mode("overwrite").parquet(str(folder / "benchmark.parquet"))
    return folder


def test_pipeline_stages_on_awkward_tables(spark, tmp_path):
    for rows in (AWKWARD, []):
        docs = frame(spark, rows, tmp_path / str(len(rows)))
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            assert set(corpus_pipeline.COLUMNS) <= set(out.columns)
            assert out.count() <= 3 * len(rows)
        assert corpus_pipeline.near_duplicates(spark, docs, DATA).count() == (len(rows) and 7)
        assert corpus_pipeline.personal_data(spark, docs, DATA).count() == len(rows)


def test_values_on_awkward_rows(spark, tmp_path):
    """What nulls, empty texts, repeated ids and a long text give, not only how many rows."""
    long_text = "word " * 200_000
    rows = [*AWKWARD, (9, long_text, "b")]
    docs = frame(spark, rows, tmp_path)
    words = sorted((len((t or "").split()) for _, t, _ in rows))
    assert sorted(r.n_words for r in quality.rate_documents(docs).collect()) == words
    assert sorted(r.n_words for r in lz_dedup.remove_passages(docs).collect()) == words
    assert sorted(r.n_tokens - 1 for r in ctw.score_documents(docs).collect()) == words
    assert sorted(r["size"] for r in mixing.mix_sources(docs).collect()) == words
    assert sorted(r.n_bytes for r in suffix_dedup.remove_repeats(docs).collect()) == sorted(len((t or "").encode()) for _, t, _ in rows)
    # Every window but the first starts earlier too, and every 200 bytes start elsewhere too.
    assert lz_dedup.remove_passages(docs).where("doc_id = 9").first().n_removed == 199_999
    assert suffix_dedup.remove_repeats(docs).where("doc_id = 9").first().n_removed == 1_000_000
    assert sorted(r.n_shingles for r in ngram_join.similar_documents(docs).collect()) == sorted(len(shingles(t)) for _, t, _ in rows)


def test_pipeline_keeps_columns_and_drops_leaks(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert set(corpus_pipeline.COLUMNS) < set(out.columns)
    rows = out.collect()
    assert rows and max(Counter((r.doc_id, r["copy"]) for r in rows).values()) == 1
    leaks = {r.doc_id for r in queries.op9_decontamination(spark, DATA).where("contaminated").collect()}
    assert not leaks & {r.doc_id for r in rows}


def test_pipeline_takes_failing_lines_out(spark, tmp_path):
    prose = " ".join(f"word{i}" for i in range(70)) + "."
    clean = prose + "\n\n \nAnd a last line follows here.\n"
    rows = [(1, f"Home | News | Contact\n{prose}\n\nAll rights reserved by the owner of it.\n", "a"), (2, clean, "a"), (3, "Home", "a")]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.quality_rules(spark, frame(spark, rows, tmp_path), DATA).collect()}
    want = {1: f"{prose}\n\n", 2: clean}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_word_shape_reads_the_whole_word():
    assert pii.word_shape("x" * 70 + "@12.34") == "a@d2.d2"
    assert pii.word_shape("-a" * 40 + "9") == "-a" * 40 + "d1"
