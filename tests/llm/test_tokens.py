import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from semiweave.llm.queries import MODEL_FILE
from semiweave.llm.tokens import CountOnlyViterbi, count_tokens, load_vocabulary


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(MODEL_FILE)


@pytest.fixture(scope="module")
def exact(vocabulary):
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_counts_equal_the_tokenizer(vocabulary, exact):
    model = CountOnlyViterbi(vocabulary)
    rng = random.Random(3)
    letters = "abcdehilnorstuéèçßü  \n\t\r▁梦ла🤦🏼<0x0A>|.," + "the of and "
    texts = ["", " ", "  a  b ", "a\nb", "\n\n", "▁x▁▁y", "unk <unk> </s>", "x" * 5000, "中文" * 50] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 90))) for _ in range(1500)]
    for text in texts:
        assert model.text(text)[0] == exact(text), repr(text)


def test_ties_take_the_longest_last_piece():
    model = CountOnlyViterbi([("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0)])
    t = Tokenizer(models.Unigram([("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0)], unk_id=0))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    for n in range(1, 12):
        assert model.text("a" * n)[0] == len(t.encode("a" * n).ids)
        assert model.text("a" * n)[1] == -1.0 - n


def test_rows_of_every_kind(spark, vocabulary, exact):
    rows = [(1, "the cat", "x"), (1, "the cat", "x"), (2, None, None), (None, "", "y"), (3, "word " * 30000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = sorted(map(tuple, count_tokens(df, vocabulary).select("doc_id", "n_tokens").collect()), key=str)
    assert got == sorted([(1, exact("the cat"))] * 2 + [(2, 0), (None, 0), (3, exact("word " * 30000))], key=str)
    assert count_tokens(df.limit(0), vocabulary).count() == 0
