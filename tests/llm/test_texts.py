"""Splitting, tokenising, keyword pages, mixing, truncation: against brute force, round trips, and odd inputs."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecframe.llm.mixing import STEPS, Mix, _budgets
from vecframe.llm.spam import is_spam, spam_pages, spam_shapes
from vecframe.llm.split import pieces, split_oversized
from vecframe.llm.tokenize import VOCABULARY, Encoder, encode_corpus
from vecframe.llm.truncation import COMPLETE, CUT, breaks_off, judge, truncated, truncation_by_source

ALPHABET = st.text(alphabet=st.sampled_from(list("aé中' \n\tr5!́🙂l.")), max_size=120)


# --- splitting


@settings(max_examples=200, deadline=None)
@given(ALPHABET, st.integers(1, 30), st.integers(0, 35))
def test_pieces_cover_and_overlap(text, limit, overlap):
    spans = pieces(text, limit, overlap)
    lap = min(overlap, limit - 1)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, _) in zip(spans, spans[1:], strict=False):
        assert b - c == lap and b - a <= limit and b > a + lap
    assert spans[-1][1] - spans[-1][0] <= max(limit, 0)


def test_strongest_boundary_wins_and_ties_go_right():
    text = "One two. Three four.\n\nFive six seven eight nine"
    assert text[: pieces(text, 30, 0)[0][1]] == "One two. Three four.\n\n"
    assert pieces("aa bb cc dd ee", 10, 0)[0] == (0, 9)
    assert pieces("abcdefghij", 4, 1) == [(0, 4), (3, 7), (6, 10)]
    assert pieces("a\r\nb" * 3, 6, 0)[0][1] in (3, 4, 6)


def test_never_inside_a_character():
    text = "é" * 10
    assert all(b % 2 == 0 for _, b in pieces(text, 5, 0)[:-1])
    family = "👩‍💻" * 6
    assert all(b % 3 == 0 for _, b in pieces(family, 7, 0)[:-1])


def test_long_text_moves_the_index(monkeypatch):
    from vecframe.llm import split

    rng = random.Random(1)
    text = "".join(rng.choice(["word ", "end. ", "\n\n", "x"]) for _ in range(4000))
    whole = pieces(text, 100, 10)
    monkeypatch.setattr(split, "BLOCK", 300)
    assert pieces(text, 100, 10) == whole


def test_split_operator(spark):
    rows = [(1, "a", "x" * 25, 1, "p"), (1, "a", "x" * 25, 2, "p"), (2, "b", "y" * 25, 1, "p"), (3, None, "z" * 99, 1, "p"), (4, "a", None, 1, "p"), (5, "a", "   ", 1, "p"), (None, "a", "w" * 11, 1, "p"), (6, "a", "é" * 10, 1, "p")]
    df = spark.createDataFrame(rows, "id bigint, partition_name string, content string, ingested_at int, piece string")
    limits = spark.createDataFrame([("a", 10, 2), ("a", 10, 2), (None, 1, 0), ("b", None, None)], "partition_name string, max_chars int, overlap_chars int")
    got = split_oversized(df, limits).collect()
    assert {r.id for r in got} == {1, None}
    mine = sorted((r.piece, r.start_char, r.end_char, r.piece_text) for r in got if r.id == 1)
    assert [m[0] for m in mine] == [0, 1, 2] and mine[0][3] == "x" * 10 and mine[1][1] == 8
    assert split_oversized(df.limit(0), limits).count() == 0 and split_oversized(df, limits.limit(0)).count() == 0


# --- tokenising


@pytest.fixture(scope="module")
def encoders():
    return Encoder(), Encoder(leaf=4, window=1)


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_tree_equals_the_whole(encoders, text):
    whole, tree = encoders
    ids = [int(i) for i in tree.encode(text)]
    assert ids == whole.bpe.encode_ordinary(text)
    assert tree.decode(ids) == text


def test_encode_operator(spark, encoders):
    long = "nana" * 30_000 + " and so on.\n" * 500
    rows = [(1, "Hello  world"), (2, ""), (3, None), (4, "<|endoftext|> x"), (5, long), (1, "Hello  world"), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = encode_corpus(df, "doc_id", "text").collect()
    by = {r.doc_id: list(r.ids) for r in got}
    assert len(got) == 7 and by[2] == [] and by[3] == [] and by[1] == encoders[0].bpe.encode_ordinary("Hello  world")
    assert 50256 not in by[4] and encoders[0].decode(by[4]) == "<|endoftext|> x"
    assert encoders[0].decode(by[5]) == long and by[5] == encoders[0].bpe.encode_ordinary(long)
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_agrees_with_the_other_library(encoders, data):
    tokenizers = pytest.importorskip("tokenizers")
    import pyarrow.parquet as pq

    t = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    texts = [x for x in pq.read_table(f"{data}/documents.parquet", columns=["text"]).column(0).to_pylist() if x]
    assert [list(map(int, encoders[0].encode(x))) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


# --- keyword pages

SPAM = [
    "cheap cache buy index cheap cache best index cheap cache online index fast cache",
    "https://a.example/x\nhttps://b.example/y\nwww.c.test/?id=3",
    '<li><a href="https://a.example">buy cache</a></li><li><a href="https://b.example">best index</a></li>',
    "c_h_e_a_p_ _c_a_c_h_e b_u_y_ _i_n_d_e_x",
    "Tags: cache, index, shard, arena, lease, worker\nbuy cache / best index / top shard / fast arena / cheap lease",
    "缓存 索引 价格 免费 最佳 缓存 购买 索引",
    "Notes on the cache - https://a.example/1\nHow to warm an index - https://b.example/2\nWhy a shard waits - https://c.example/3",
]
HAM = [
    "The cache of the index holds every shard. It forwards some rows to the worker.",
    "2025-01-24T19:51:43Z WARN pin_manifest holds cache in 372 ms\n2025-01-25T19:51:43Z INFO counter probes alias in 3 ms",
    "```\ncache = index[3]\nreturn cache\n```\nSee the code.",
    "timeout = 30\nmax_rows = 500\nretry: 3",
    "| name | type | default |\n| cache | int | 3 |\n| index | float | 0.5 |",
    "cache: the place where a value is kept.\nindex: a list of the places of each word.",
    "缓存比较字段节点。索引检查过滤排序,快照限制副本向量召回。",
    "",
    "  \n ",
]


@pytest.mark.parametrize("text", SPAM)
def test_spam(text):
    assert is_spam(text)


@pytest.mark.parametrize("text", HAM)
def test_ham(text):
    assert not is_spam(text)


PROSE = {
    "italian": "Il gatto dorme sul divano della nonna mentre fuori piove. La strada per il mercato passa vicino al fiume, dove i bambini giocano ogni giorno.",
    "polish": "Wczoraj wieczorem poszliśmy do kina, bo grali nowy film o morzu. Potem długo rozmawialiśmy przy herbacie i wróciliśmy późno do domu.",
    "russian": "Вчера мы долго гуляли по парку и говорили о новой книге. Погода была тёплая, хотя к вечеру пошёл дождь.",
    "arabic": "ذهب الولد إلى المدرسة في الصباح الباكر مع أخيه الصغير. كانت السماء صافية وكان الطريق طويلا بين الحقول.",
    "portuguese": "O menino foi cedo para a escola com o irmão mais novo. A rua estava vazia e o vento soprava forte entre as casas.",
    "dutch": "Gisteren gingen wij naar het strand omdat de zon eindelijk scheen. Mijn broer nam zijn hond mee, die de hele dag achter de golven aan rende.",
    "swedish": "I går gick vi till skogen för att plocka svamp med farmor. Det regnade lite på morgonen men sedan kom solen fram.",
    "turkish": "Dün sabah erkenden kalkıp deniz kenarında uzun bir yürüyüş yaptık. Hava serindi ama güneş yavaş yavaş yükseliyordu.",
    "greek": "Χθες το πρωί πήγαμε με τον αδερφό μου στην αγορά του χωριού. Ο καιρός ήταν καλός και ο κόσμος γελούσε στους δρόμους.",
    "english": "The boy went to school early with his brother. The road was empty and the wind blew between the houses.",
}


@pytest.mark.parametrize("language", sorted(PROSE))
def test_prose_of_any_language_is_no_spam(language):
    assert not is_spam(PROSE[language]) and not is_spam("\n\n".join([PROSE[language]] * 2))
    # Its words heaped up are.
    assert is_spam(", ".join(w.strip(".,") for w in PROSE[language].split() if len(w) > 4) + "\n")


def test_spam_operator(spark):
    rows = [(1, SPAM[0]), (2, HAM[0]), (3, None), (4, ""), (1, SPAM[0]), (5, "a, b; " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spam", F.lit(1))
    got = spam_pages(df).collect()
    assert sorted(r.doc_id for r in got if r.spam) == [1, 1, 5] and len(got) == 6
    assert spam_pages(df.limit(0)).count() == 0 and spam_shapes(df.limit(0)).count() == 0
    assert spam_shapes(df).agg(F.sum("words")).first()[0] == sum(r.words for r in got)


# --- mixing


def _mix(spark, docs, targets, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("tokens", F.lit("clash"))
    t = spark.createDataFrame(targets, "mix_name string, source string, weight double, max_repeats int, size_ratio double")
    return Mix(d, t, **options)


def test_mix_shares_and_caps(spark):
    rng = random.Random(3)
    word = ["cache", "index", "shard", "row"]
    docs = [(i, " ".join(rng.choice(word) for _ in range(rng.randrange(20, 60))), "a" if i % 3 else "b") for i in range(900)]
    docs += [(9001, None, "a"), (9002, "", "b"), (9003, "cache", None)]
    targets = [("m", "a", 1.0, 1, 0.9), ("m", "b", 3.0, 3, 0.9), ("n", "b", 1.0, 1, 2.0), ("n", "gone", 1.0, 2, 2.0), (None, "a", 1.0, 1, 1.0), ("m", None, 1.0, 1, 1.0), ("o", "a", -1.0, 1, 1.0)]
    mix = _mix(spark, docs, targets, steps=16)
    shares = {(r.mix_name, r.source): r for r in mix.shares().collect()}
    assert set(shares) == {("m", "a"), ("m", "b"), ("n", "b"), ("n", "gone")}
    assert shares["m", "a"].actual_share == pytest.approx(0.25, abs=0.005) and shares["m", "b"].actual_share == pytest.approx(0.75, abs=0.005)
    assert shares["n", "b"].most_repeats == 1 and shares["n", "gone"].actual_tokens == 0
    chosen = mix.choice().collect()
    assert len({(r.mix_name, r.doc_id) for r in chosen}) == len(chosen)
    assert all(r.repeats <= 3 and r.tokens > 0 for r in chosen) and not {9001, 9002, 9003} & {r.doc_id for r in chosen}
    # Whole epochs first: the repeats of a source differ by one at most.
    b = {r.repeats for r in chosen if r.mix_name == "m" and r.source == "b"}
    assert max(b) - min(b) <= 1
    again = _mix(spark, list(reversed(docs)), targets, steps=64)
    assert sorted(map(tuple, again.choice().collect())) == sorted(map(tuple, chosen))


@pytest.mark.parametrize("quality", [1.0, 0.01])
def test_no_bucket_of_keys_holds_much_of_a_source(spark, quality):
    rows = spark.range(50_000).select(F.lit("m").alias("mix_name"), "id")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(7), "mix_name", "id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    most = rows.groupBy(F.floor(F.log(-F.log(u) / quality) * STEPS)).count().agg(F.max("count")).first()[0]
    assert most < 0.01 * 50_000
    docs = [(i, "cache row " * 8, "a") for i in range(200)]
    mix = _mix(spark, docs, [("m", "a", 1.0, 1, 0.5)], quality=F.lit(quality))
    assert mix.choice().count() == 100


def test_empty_mix(spark):
    assert _mix(spark, [], [("m", "a", 1.0, 1, 1.0)]).choice().count() == 0
    m = _mix(spark, [(1, "cache", "a")], [])
    assert m.choice().count() == 0 and m.shares().count() == 0


def test_budgets_fill_up():
    import pandas as pd

    b = _budgets(pd.DataFrame({"mix_name": "m", "source": ["a", "b", "c"], "weight": [1.0, 1.0, 2.0], "max_repeats": [1, 2, 4], "size_ratio": 1.0, "tokens": [10, 100, 50], "all_tokens": 160}))
    assert b.budget.sum() == pytest.approx(160) and b.budget[0] == 10 and b.budget[1] == pytest.approx(50) and b.budget[2] == pytest.approx(100)
    assert b.epochs.tolist() == [1, 0, 2] and b.rest.tolist() == pytest.approx([0, 50, 0])


# --- truncation


@pytest.mark.parametrize(
    ("value", "title", "verdict"),
    [
        ("A sentence ended. Another beg", False, CUT),
        ("A sentence ended. And another one…", False, CUT),
        ("A sentence ended. And anoth [...]", False, CUT),
        ("A sentence ended. The next Read more", False, CUT),
        ("It covers shards, rows, and so on...", False, COMPLETE),
        ("A sentence ended. Une fronti�", False, CUT),
        ("A sentence ended.\n\nSee https://a.example/chunk/544", False, COMPLETE),
        ("A sentence ended.\n\nSee https://a.exam", False, CUT),
        ("A sentence ended.\n\n-- \nThe queue desk, build 9632", False, COMPLETE),
        ("A sentence ended.\n\n-- \nThe queue desk, bu", False, CUT),
        ("Text.\n\n```\ncall(3)\n```", False, COMPLETE),
        ("Text.\n\n```\ncall", False, CUT),
        ('They called it "partial release."', False, COMPLETE),
        ("<p>A sentence.</p>", False, COMPLETE),
        ("How to warm the cach…", True, CUT),
        ("Why does it wait?", True, COMPLETE),
        ("FIELD FAQ (part 4)", True, COMPLETE),
        ("…", False, COMPLETE),
    ],
)
def test_judgement(value, title, verdict):
    assert judge(value, title)[0] == verdict


def test_alignment():
    whole = "Every row of the old table waits for a worker. Then the cache is warmed by the second shard."
    assert breaks_off("Every row of the old table waits for a worker. Then the cache is war", whole)
    assert breaks_off("Every row of the old table waits for a worker. Then the cache is warmed", whole)
    assert not breaks_off("Every row of the old table waits for a worker.", whole)
    assert not breaks_off("Every row of the old table waits for a worker", whole)
    assert not breaks_off(whole, whole) and not breaks_off("", whole) and not breaks_off("something else that is not there at all", whole)


def test_truncation_operator(spark):
    base = "The worker of the {n} shard warms every cache before the index. Some rows of the table wait for a lease. Each probe reads the cache of the {n} index."
    rows = [(i, base.format(n=w), f"Notes on the {w} cache", "s1", 1) for i, w in enumerate(("red", "blue", "old", "new", "fine", "wide"))]
    rows += [(10, "The worker of the red shard warms every cache before the index. Some rows of the table wait for a lea", "Notes on the", "s1", 1)]
    rows += [(11, base.format(n="red") + " Ever", None, None, 1), (11, base.format(n="red") + " Ever", None, None, 2), (12, None, " ", "s2", 1), (13, "", "", "s2", 1), (None, "Some text that bre", "t", "s2", 1), (14, "word " * 60_000 + "end.", "x" * 500 + " cache", "s2", 1)]
    df = spark.createDataFrame(rows, "id bigint, content string, title string, source string, ingested_at int").withColumn("cut", F.lit("clash"))
    got = {(r.id, r.field_name) for r in truncated(df).where("cut").collect()}
    assert {(10, "content"), (10, "title"), (11, "content")} <= got and not {(i, "content") for i in (*range(6), 14)} & got
    by = {r.source: r for r in truncation_by_source(df).collect()}
    assert by[None].contents == 1 and by[None].content_share == 1.0 and by["s1"].contents == 7 and by["s1"].contents_cut == 1
    assert truncated(df.limit(0)).count() == 0


def _corpus(n: int, seed: int = 5, longer: int = 0) -> list[str]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(400)]
    return [" ".join(" ".join(rng.choice(words) for _ in range(rng.randint(6, 12))).capitalize() + "." for _ in range(rng.randint(5, 9) + longer)) for _ in range(n)]


def test_near_copies_show_planted_cuts(spark):
    """Copies cut to 25 to 90 % with an edit: nearly all are shown by the copy that goes on, none of the whole ones."""
    rng = random.Random(9)
    rows, cut = [], set()
    for i, text in enumerate(_corpus(200, longer=12)):
        rows.append((2 * i, text))
        at = int(len(text) * rng.uniform(0.25, 0.9))
        while not (text[at - 1].isalnum() and text[at].isalnum()):
            at -= 1
        part = text[:at].split(" ")
        part[len(part) // 2] = "edited"
        rows.append((2 * i + 1, " ".join(part)))
        cut.add(2 * i + 1)
    df = spark.createDataFrame([(i, None, t, None) for i, t in rows], "id long, source string, content string, title string")
    got = truncated(df, version=None).where("field_name = 'content'").collect()
    shown = {r.id for r in got if r.near_copy}
    assert shown <= cut and len(shown) >= 0.9 * len(cut)
    assert {r.id for r in got if r.cut} == cut


@pytest.mark.parametrize("times", [1, 40])
def test_pieces_of_words_close_no_title_however_often(spark, times):
    """The same cut title many times over does not make its piece of a word a word."""
    texts = _corpus(60)
    whole = [" ".join(t.split(" ")[:4]).rstrip(".") for t in texts]
    rows = [(i, None, t, w) for i, (t, w) in enumerate(zip(texts, whole, strict=True))]
    rows += [(1000 + i, None, f"{t} The end.", " ".join(w.split(" ")[:3]) + " qu") for i, (t, w) in enumerate(zip(texts * times, whole * times, strict=True))]
    df = spark.createDataFrame(rows, "id long, source string, content string, title string")
    cut = {r.id for r in truncated(df, version=None).where("field_name = 'title' and cut").collect()}
    assert {i for i in cut if i >= 1000} == {r[0] for r in rows if r[0] >= 1000}


def test_null_versions_are_kept(spark):
    df = spark.createDataFrame([(1, None, "It is all there.", None, None), (1, None, "It is all there.", None, None), (2, None, "Some words. Then it is all the", None, None)], "id long, source string, content string, title string, ingested_at timestamp")
    assert {(r.id, r.cut) for r in truncated(df).collect()} == {(1, False), (2, True)}


def test_every_partner_of_a_bucket_is_met(spark):
    """Eighty texts of one opening: cut copies whose whole texts are neither the longest of the bucket nor of a share of it."""
    import random

    rng = random.Random(21)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    start = words(40)
    whole = [f"{start} {words(300 + 5 * i)} stop." for i in range(80)]
    rows = [(i, "s", t, None) for i, t in enumerate(whole)]
    # Closed by a word that closes texts: only the near-copy shows the cut.
    rows += [(1000 + i, "s", " ".join([*t.split()[:250], "stop"]), None) for i, t in enumerate(whole[:20])]
    rows += [(1500, "s", rows[-1][2], None)]
    rows = [(k, s, t.replace("stop.", "stop and go on to the end.") if k < 20 else t, None) for k, s, t, _ in rows]
    rows = [(k, s, t.replace(t.split()[250], "stop", 1) if k < 20 else t, None) for k, s, t, _ in rows]
    rows += [(2000 + i, "s", None, f"how to read the manual{tail}") for i, tail in enumerate([" a", " b", " of zebras", "s and more", ""])]
    df = spark.createDataFrame(rows, "id long, source string, content string, title string")
    got = {(r.id, r.field_name) for r in truncated(df, version=None).where("near_copy").collect()}
    assert {(1000 + i, "content") for i in range(20)} | {(1500, "content")} <= got and not {k for k, _ in got} & set(range(80))


def test_likely_copies_lose_no_pair():
    import random

    from vecframe.llm import truncation

    rng = random.Random(22)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 80))] for _ in range(12)]
    texts = [" ".join(b[: rng.randrange(8, len(b))] + [f"v{rng.randrange(60)}" for _ in range(rng.randrange(4))]) for b in base for _ in range(8)]
    h, doc = truncation.shingle_sets(texts, 5)
    sets = [set(h[doc == i].tolist()) for i in range(len(texts))]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * min(len(sets[i]), len(sets[j]))}
    a, b = truncation._likely_copies(texts, 5, 0.8)
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    assert want <= got and len(want) > 100 and len(got) == len(a)
