from burstlake.sources.settings import read_texts, setting_lists

TEXT = """# settings
targets:
  - "before_0001"
  # No0134 (first night)
  - "2017-04-03-08_16_13_142_0006_t10.882_t25.829"   # two pulses
  files: # plain comment
    - "2017-04-03-133831_0008"
    - "x20170403"
    - unquoted_0009
    - ""
#No7
-"a_12345_0011.fits"
  - "2017-04-03-133831_0008"
  - "no part_t5."
  - "next" # No8
"""


def test_lists_under_headings(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(TEXT)
    (tmp_path / "b.yaml").write_text(TEXT.replace("\n", "\r\n"))
    (tmp_path / "c.yaml").write_text("")
    got = [tuple(r)[1:] for r in setting_lists(read_texts(spark, str(tmp_path / "a.yaml"))).orderBy("line").collect()]
    assert got == [
        (4, "No0134", "2017-04-03-08_16_13_142_0006_t10.882_t25.829", "0006", [10.882, 25.829]), (6, "No0134", "2017-04-03-133831_0008", "0008", []), (7, "No0134", "x20170403", "0403", []),
        (11, "No7", "a_12345_0011.fits", "0011", []), (12, "No7", "2017-04-03-133831_0008", "0008", []), (13, "No7", "no part_t5.", None, [5.0]),
    ]
    every = setting_lists(read_texts(spark, str(tmp_path)))
    assert every.count() == 12 and every.select("file").distinct().count() == 2
    assert setting_lists(spark.createDataFrame([("x", None), (None, TEXT)], "file string, text string")).count() == 0
