"""Page text beside elements that are not blocks."""

import pytest

from fleetpulse.llm import html_tree

PAGE = "<nav><li>Menu</li></nav><article><p>Some text.</p><p>More text.</p></article><footer>End"


@pytest.mark.parametrize(
    "between",
    [
        "<svg class=i/>", '<svg class="i" />', "<math/>", "<svg-icon name=x></svg-icon>",
        "<object-view></object-view>", "<style-guide>", "<script-x/>", "<template>", "<svg>",
        "<script>var a = '<p>no</p>';</script >", "<style data-a='>'>p > a {}</STYLE>",
        "<script data-a=it's>no('no')</script>", "<svg><style/><path d='M0'/></svg>",
        "<svg><script href='a.js'/></svg>", "<script>'</script-x>'</script>", "<iframe src=x>",
    ],
)
def test_no_element_swallows_what_follows(between):
    model = html_tree.fit([PAGE])
    page = f"<article><p>one</p>{between}<p>two</p><p>three it's</p></article>"
    assert model.text(page) == "one\n\ntwo\n\nthree it's"


def test_only_scripts_and_styles_hold_no_text():
    model = html_tree.fit([PAGE])
    page = (
        "<article><p>Let <math><mi>x</mi></math> be.<object data=a>Two</object>"
        "<noscript> three</noscript><template> four</template></p><object><p>Five.</p></object>"
        "<svg><title>Icon</title><text>Six.</text></svg><script>no</script></article>"
    )
    assert model.text(page) == "Let x be.Two three four\n\nFive.\n\nSix."
