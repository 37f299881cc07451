"""The page parser's short ways give what the forgiving parser gives."""

import random
from html.parser import HTMLParser

from careflow.llm import extraction as X


class _Forgiving(X._Builder):
    parse_starttag = HTMLParser.parse_starttag
    parse_endtag = HTMLParser.parse_endtag
    updatepos = HTMLParser.updatepos


def _shape(node):
    return node.tag, node.named, node.hidden, node.text, [_shape(k) for k in node.kids]


BITS = ['<p>', '</p>', '<p class="ad">', "<p class='ad'>", '<p class="ad" id="x">', '<p class="ad"id="x">', '<P>', '<br/>',
        '<p class="">', '<p hidden>', '<p aria-hidden="true">', '<a href="?a=1&amp;b">', '<a href="x<y">', '</a >', '</>',
        '<script>', 'if (a<b) "</p>"', '</script>', '<style>', '</style>', '<title>', '</title>', '<textarea>', '<li>',
        '<!-- ', '-->', '&lt;', '& ', 'text', '\n', '<', '>', '</', '<x', '<article>', '</article>', '<my-tag>', '<td>']


def test_plain_tags_parse_as_forgiven_ones():
    rnd = random.Random(3)
    for _ in range(3000):
        html = "".join(rnd.choices(BITS, k=rnd.randint(1, 20)))
        b = _Forgiving()
        b.feed(html)
        b.close()
        assert _shape(X.parse(html)) == _shape(b.root), html


def test_survey_hashes_no_subtrees(monkeypatch):
    seen = []
    monkeypatch.setattr(X, "_mark", seen.append)
    X.survey("<article><p>One  two​ three </p></article>")
    assert not seen


def test_blanks():
    assert X.one_line(" a ​\n b\x1c") == "a b" and X.one_line("​ ") == ""
    assert X._spaced("​a  b\n") == " a b " and X._spaced("\n\n") == " " and X._spaced("") == ""
