import json

import pytest

from foliograph import cli
from tests.test_layout import GRID, block


@pytest.mark.parametrize("args, code", [(["families", "-m", "3528B"], {0, 1}), (["retrieval"], {0}), (["lab", "--arm", "no_filter"], {0}), (["evals", "-c", "part_number"], {0}), (["trace"], {0}), (["verify"], {0, 1}), (["gate", "--prefixes", "BR9"], {0, 1}), (["query", "torque of the piston", "-m", "3528B", "--top-n", "3"], {0})])
def test_commands(spark, data, args, code, capsys):
    assert cli.main([args[0], "--tables", data, *args[1:]]) in code
    assert capsys.readouterr().out


def test_ranks(spark, data, tmp_path):
    from foliograph.sources import files

    assert cli.main(["ranks", "--tables", data, "--out", str(tmp_path / "r")]) == 0
    assert files.read_ranks(spark, str(tmp_path / "r")).count() > 0


def test_from_layout_to_tables(spark, data, tmp_path):
    """Layout to chunk files to tables, and once more: the second load replaces the first."""
    bold = 16
    blocks = [block(0, 60, 70, 300, "i00000001 Air Shutoff", 15.9, bold), block(1, 60, 200, 300, "Two", 13.9, bold), block(2, 60, 220, 300, "1. Stop."), block(3, 60, 240, 300, "Three", 12.0, bold), block(4, 60, 260, 300, "body " * 60)]
    names = ("doc", "page", "block_no", "type", "bbox", "lines")
    for name, rows in (("layout_blocks", [dict(zip(names, b)) for b in blocks]), ("layout_drawings", [dict(zip(("doc", "page", "seq", "type", "x0", "y0", "x1", "y1"), ("d", 1, i, "f", *map(float, g)))) for i, g in enumerate(GRID)])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    assert cli.main(["cut", "--tables", str(tmp_path), "--out", str(tmp_path / "chunks")]) == 0
    assert cli.main(["gate", "--tables", data, "--layout", str(tmp_path)]) == 1
    assert cli.main(["verify", "--tables", data, "--layout", str(tmp_path)]) == 1
    for _ in range(2):
        assert cli.main(["load", "--tables", data, "--files", str(tmp_path / "chunks"), "--out", str(tmp_path / "db")]) == 0
    got = spark.read.parquet(str(tmp_path / "db/chunks")).collect()
    assert [g.heading for g in got] == ["Air Shutoff"] and len(got[0].embedding_dense) == 64 and got[0].icode == "i00000001"
