"""Pages whose head or svg has no end tag keep their text; scripts with long opening tags keep their link."""

from concordat.llm import warc


def test_text_behind_an_open_head():
    assert warc.plain_text("<html><head><title>T</title><body><p>text") == "text"
    assert warc.plain_text("<head><meta charset=utf-8>\n<title>T</title><link rel=x><style>p {}</style><!-- c --><p>one<p>two") == "one\ntwo"
    assert warc.plain_text("<head><title>T</title>words <b>go</b> on") == "words go on"
    assert warc.plain_text("<head><title>T</title><script>'<body>no'</script></head><body>yes</body>") == "yes"
    assert warc.plain_text("<head><title>T</title></head><header>top</header><p>text") == "top\ntext"


def test_text_behind_an_svg():
    assert warc.plain_text("<p>a <svg width='1' /> b</p><p>c</p>") == "a b\nc"
    assert warc.plain_text("<p>a</p><svg><text>no</text><p>b</p>") == "a\nb"
    assert warc.plain_text("<p>a</p><svg><text>no</text></svg><p>b</p>") == "a\nb"


def test_script_source_anywhere_in_its_tag():
    page = f"<script data-x='{'x' * 400}'\nsrc='/far.js'>'<a href=/no>'</script><script>document.write(\"<img src='/no.png'>\")</script>"
    assert warc.links(page, "https://example.org/") == [("script", "https://example.org/far.js")]
