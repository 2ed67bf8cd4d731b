"""Files of one row each are shared out between tasks by their number, not by their bytes."""

import glob
from collections import Counter

from colloquy.sources import writers as W


def test_files_of_a_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "FILES_PER_TASK", 4)
    texts = spark.range(60).selectExpr("concat('text ', id) AS value").coalesce(1)
    W.write_file_each(texts, f"{tmp_path}/files")
    names = glob.glob(f"{tmp_path}/files/*.txt")
    assert sorted(open(name).read() for name in names) == sorted(f"text {i}\n" for i in range(60))
    of_task = Counter(name.split("/part-")[1][:5] for name in names)
    assert len(of_task) >= 8 and max(of_task.values()) <= 12
