import pytest

from glyphlake import cli


@pytest.mark.parametrize("argv, out", [
    (["convert", "arpa", "ipa", "HH AH0 L OW1"], "həloʊ"), (["convert", "hira", "kana", "らーめん"], "ラーメン"), (["detect", "привет"], "Cyrl"), (["direction", "abc"], "ltr"), (["decompose", "값"], "ㄱㅏㅄ"),
    (["lang", "sr-Latn"], "Latn"), (["strip", "tashkeel", "مُحَمَّدٌ"], "محمد"), (["restyle", "pinyin-tone", "number", "fāngān"], "fan1gan1"), (["phonemize", "graphemes", "Ab-c"], "ab-c"), (["distribution", "ab"], '[{"script":"Latn","count":2}]'),
    (["route", "arpa", "x-sampa"], "arpa -> ipa (lossy) -> x-sampa (lossless)"), (["conventions", "Hebr"], "niqqud\nteamim"),
])
def test_verbs(spark, capsys, argv, out):
    assert cli.main(argv) == 0
    assert capsys.readouterr().out.strip() == out


def test_file(spark, tmp_path, capsys):
    (tmp_path / "in.txt").write_text("AY1\n\nHH AH0\n")
    assert cli.main(["convert", "arpa", "ipa", "--file", str(tmp_path / "in.txt")]) == 0
    assert capsys.readouterr().out == "aɪ\n\nhə\n"
    with pytest.raises(SystemExit):
        cli.main(["detect"])
    with pytest.raises(ValueError, match="reachable"):
        cli.main(["convert", "ipa", "klingon", "x"])
