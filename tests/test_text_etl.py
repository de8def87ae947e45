from tallyloom.plans.text_etl import split_lines, words_of
from tallyloom.sources.readers import lines_of, read_text
from tallyloom.sinks.writers import plan_text

# Lines that must be kept, between others that must not.
SIXTEEN = """One line opens the file here today.
Someone's second line has six words.
After it a line with seven words.
A fox ran over the hill and was gone.
Every test needs a few rows to drop.
Nothing in this row is looked for.
Short one.
The fourth row to leave out says little.
Rain fell all day on the old roof.
Two more such rows and we are done.
Numbers like 4 and 5 do not help either.
A line may hold digits 42 or @&!.
This textual line should be kept like others.
Words come and words go.
Whoever wants more rows can write another ten lines here.
At the very end there stands one more line.
"""


def test_sixteen_line_file(spark, tmp_path):
    path = tmp_path / "example.txt"
    path.write_text(SIXTEEN)
    words = words_of(read_text(spark, str(path)))
    assert words.columns == ["words_array"]
    assert sorted(len(r[0]) for r in words.collect()) == sorted([7, 6, 7, 8, 8, 10, 9])


def test_edge_lines(spark):
    lines = [
        ("a LINE in capitals",), ("line about apache tools",), ("one line",), ("",), ("line  gap",), (None,), ("line with APACHE here",)
    ]
    kept = split_lines(spark.createDataFrame(lines, "value string")).collect()
    found = {r["value"]: r["words_array"] for r in kept}
    # A doubled blank makes an empty word, which counts.
    assert found == {
        "a LINE in capitals": ["a", "LINE", "in", "capitals"],
        "line  gap": ["line", "", "gap"],
        "line with APACHE here": ["line", "with", "APACHE", "here"],
    }


def test_filters_reach_the_scan(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text(SIXTEEN)
    plan = plan_text(words_of(read_text(spark, str(path))))
    assert "Not(StringContains(value,apache))" in plan
    assert plan.count("Filter [") <= 1 and "Exchange" not in plan


def test_lines_of_keeps_whole_texts(spark):
    df = spark.createDataFrame([(1, "a\nb\r\nc\rd"), (2, ""), (3, "x" * 200_000 + "\nend")], "id int, text string")
    got = [(r["id"], len(r["value"])) for r in lines_of(df, "text").orderBy("id").collect()]
    assert sorted(got) == sorted([(1, 1)] * 4 + [(2, 0), (3, 200_000), (3, 3)])
