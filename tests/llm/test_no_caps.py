"""What is long or large is treated as what is short or small."""

from oracle import FOLDER

from siftgrain.llm import leakage, queries, secrets, sentences, splitting


def test_a_stored_model_gives_the_same_sentences(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    learned = sentences.learn(sentences.cut_lineage(sentences.corpus_counts(documents)))
    stored = sentences.collect_model(learned, limit=0, shards=16)
    assert isinstance(stored, sentences.StoredModel) and learned.count() > 20
    want = sorted(map(tuple, queries.p10_found(spark, FOLDER).collect()))
    assert sorted(map(tuple, sentences.sentence_ends(documents, stored, starts=False).collect())) == want


def test_long_tokens_are_read_whole():
    token = "x" * 5000
    assert sentences._before(f"a {token}", 0, 5002) == token
    assert sentences._before(token, 0, 5000) == token and sentences._before("a ", 0, 2) == ""


def test_long_abbreviations_are_learned(spark):
    lines = [f"Siehe Verordnungsbl. {k} im Anhang und lies den Text der Nummer weiter." for k in range(400)] + ["Das ist der Text. Die Sache ist klar. Der Rest folgt." for _ in range(400)]
    documents = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "doc_id bigint, text string")
    counts = {(r.kind, r.a) for r in sentences.corpus_counts(documents).collect()}
    assert ("p", "verordnungsbl") in counts


def test_long_tags_are_markup():
    tag = '<span class="' + "x " * 400 + '">'
    assert leakage.words(f"one {tag}two</span> three") == ["one", "two", "three"]


def test_items_are_searched_in_rounds_of_bytes(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{FOLDER}/eval_items.parquet")
    want = sorted(map(tuple, queries.p9_found(spark, FOLDER).collect()))
    assert sorted(map(tuple, leakage.leaked_items(documents, items, round_bytes=20_000).collect())) == want


def test_the_whole_overlap_is_kept():
    text = " ".join(f"word{k}" for k in range(200))
    got = splitting.pieces(text, 100, 80)
    assert all(b - a <= 100 for a, b in got) and all(before[1] - after[0] == 80 for before, after in zip(got, got[1:]))


def test_long_secrets_are_found():
    value = "aB3$" * 10 + "".join(chr(33 + k * 7 % 90) for k in range(4800)).replace('"', "Q").replace("\\", "z").replace("<", "L").replace("{", "m").replace("}", "n").replace("*", "7").replace(".", "5").replace("%", "6").replace("x", "y")
    assert [n for n, _ in secrets.find_credentials(f'secret = "{value}"')] == [1]
