"""The pipeline decides by row: repeated rows, and shared and null ids."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
from memspark.llm import near_dups

LAYOUT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_rows_with_one_id(spark, tmp_path):
    r = random.Random(22)
    syl = ["the", "and", "ing", "er", "tion", "ou", "sh"]
    text = lambda n: " ".join("".join(r.choice(syl) for _ in range(3)) for _ in range(n))
    item = text(20)
    leak = lambda: text(60) + " " + item + " " + text(60)
    rows = [(i, text(90)) for i in range(40)]
    twice, fresh, clean = text(150), [text(90) for _ in range(6)], Counter()
    assert len(twice) > 400
    rows += [(100, twice)] * 3 + [(200, fresh[0]), (200, fresh[1])]
    rows += [(201, fresh[2]), (201, rows[3][1]), (None, fresh[3]), (None, leak()), (None, fresh[4]), (None, rows[5][1]), (202, fresh[5]), (202, leak())]
    clean.update(rows[:41] + [(200, fresh[0]), (200, fresh[1]), (201, fresh[2]), (None, fresh[3]), (None, fresh[4]), (202, fresh[5])])
    spark.createDataFrame([(i, t, "en", f"s{k % 2}", len(t)) for k, (i, t) in enumerate(rows)], LAYOUT).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((x.doc_id, x.decoded_sha256) for x in out) == Counter((i, sha(t)) for i, t in clean.elements())


def test_one_row_of_a_class_is_kept(spark):
    a, b = "a b c d e f g", "A b c d e f g!"
    rows = [(7, a), (7, a), (7, b), (8, a), (None, a), (None, "p q r s t u v"), (None, "p q r s t u v"), (9, None), (9, "")]
    out = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(out) == len(rows)
    assert Counter((x.class_id, x.class_size) for x in out if x.is_kept) == {(7, 5): 1, (None, 2): 1, (9, 2): 1}
