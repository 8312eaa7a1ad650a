"""Command line runs over a small folder."""

from test_corpus import TREE

from proofmill import cli


def lay_out(root):
    for path, text in TREE.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    return str(root)


def lines(folder):
    return [s for part in sorted(folder.glob("part-*")) for s in part.read_text().splitlines()]


def test_first_and_combine(spark, tmp_path):
    root, out = lay_out(tmp_path / "root"), tmp_path / "out"
    cli.main(["first", root, "-o", str(out)], spark)
    for project, n in (("2", 2), ("10", 2)):
        halves = [lines(out / "text" / half / f"project_id={project}") for half in ("assert", "prefix_focal")]
        assert [len(h) for h in halves] == [n, n]

    flat = tmp_path / "flat"
    flat.mkdir()
    for project in ("2", "10"):
        for half in ("assert", "prefix_focal"):
            text = "\n".join(lines(out / "text" / half / f"project_id={project}"))
            (flat / f"{project}_{half}.txt").write_text(text + "\n")
    cli.main(["combine", str(flat), "-o", str(tmp_path / "all")], spark)
    combined = lines(tmp_path / "all" / "all_prefix_focal")
    assert len(combined) == 4
    assert "int base ( )" in combined[0] and combined[3].endswith("<UnknownFocalMethodText>")


def test_per_assert_with_project_filter(spark, tmp_path):
    root, out = lay_out(tmp_path / "root"), tmp_path / "out"
    cli.main(["per-assert", root, "-o", str(out), "--projects", "2_"], spark)
    assert len(lines(out / "text" / "assert")) == len(lines(out / "text" / "prefix_focal")) == 2
    assert "project,bug_num,test_name" in next((out / "meta.csv").glob("part-*")).read_text()
