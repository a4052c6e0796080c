"""Pages written by hand, in layouts that the training's generator does not draw: how many blocks are told right."""

import pytest

from quillstone.llm import html_blocks as blocks
from quillstone.llm import html_extraction

SF = "/root/testdata/sf0.01"
#: Page, and the blocks of its main text.
PAGES = {
    "image first": (
        "<nav><a href=/>Home</a></nav><article><p><img src=a.png>The river rose in the night, and by morning the lower road was gone.</p></article>",
        ["The river rose in the night, and by morning the lower road was gone."],
    ),
    "image after an advert": (
        "<body><article><h1>Flood</h1><div class=ad>Buy boots</div><p><img>Nobody in the valley had ever seen the water so high.</p></article></body>",
        ["Flood", "Nobody in the valley had ever seen the water so high."],
    ),
    "break first in a footer": (
        "<article><h1>Flood</h1><p>The bridge stood until noon, and then it went.</p></article><footer><br>All rights reserved, The Valley Post</footer>",
        ["Flood", "The bridge stood until noon, and then it went."],
    ),
    "image first in a comment": (
        "<article><h1>Flood</h1><p>The bridge stood until noon, and then it went.</p></article><div class=comments><div class=comment><img>I liked this very much.</div></div>",
        ["Flood", "The bridge stood until noon, and then it went."],
    ),
    "controls in an article": (
        "<article><h1>Flood</h1><p>They went on foot.</p><button>Share this</button><p>It took them two days.</p><textarea>Your opinion</textarea>"
        "<select><option>One star<option>Two stars</select><form><label>Mail</label><input></form></article>",
        ["Flood", "They went on foot.", "It took them two days."],
    ),
    "weblog": (
        "<html><head><title>Blog</title></head><body class='home blog'><div id='page' class='site'><header id='masthead' class='site-header'><h1 class='site-title'><a href=/>My days</a></h1>"
        "<nav id='site-navigation'><ul><li><a>About</a></li><li><a>Archive</a></li></ul></nav></header><div id='content' class='site-content'><div id='primary'><main id='main'>"
        "<article id='post-7' class='post'><h2 class='entry-title'>A walk along the river</h2><div class='entry-content'><p>We set out at six, when the fog still lay on the fields.</p>"
        "<ul><li>Bread and cheese</li><li>A map from 1931</li></ul><p>The path was under water for a mile.</p></div></article>"
        "<div id='comments' class='comments-area'><ol class='comment-list'><li class='comment'><p>What a lovely story, thank you.</p></li></ol></div></main></div>"
        "<aside id='secondary' class='widget-area'><section class='widget'><h2>Recent posts</h2><ul><li><a>Rain</a></li></ul></section></aside></div>"
        "<footer class='site-footer'><div>Proudly made by hand</div></footer></div></body></html>",
        ["A walk along the river", "We set out at six, when the fog still lay on the fields.", "Bread and cheese", "A map from 1931", "The path was under water for a mile."],
    ),
    "old table page": (
        "<body><table><tr><td><div class='menu'><a>News</a><br><a>Sport</a></div></td><td><div class='content'><h2>Council meets</h2><p>The council met on Tuesday to speak about the dam.<p>It was late when they ended.</div></td></tr></table>"
        "<div class='copyright footer'>Copyright 1998</div>",
        ["Council meets", "The council met on Tuesday to speak about the dam.", "It was late when they ended."],
    ),
    "cookie bar and dialog": (
        "<div id='cookie-banner' role='dialog'><p>We value your privacy.</p><button>Accept all</button></div><main><h1>Tides</h1><p>The tide tables of the harbour are kept since 1801.</p>"
        "<div class='newsletter-signup'><h3>Never miss a tide</h3><form><input><button>Sign up</button></form></div><p>They are read every morning.</p></main>",
        ["Tides", "The tide tables of the harbour are kept since 1801.", "They are read every morning."],
    ),
    "entities, code and quotes": (
        "<article><h1>5 &lt; 6 &amp; so on</h1><blockquote><p>&ldquo;So it is,&rdquo; she said.</p></blockquote><pre><code>x = 1\n  y = 2</code></pre><table><tr><th>Year</th><td>1931</td></tr></table></article><footer><p>&copy; us</p></footer>",
        ["5 < 6 & so on", "“So it is,” she said.", "x = 1 y = 2", "Year", "1931"],
    ),
    "advert between paragraphs": (
        "<div class='story'><h1>Storm</h1><p>The storm came from the west and stayed.</p><div class='advertisement'><p>Cheap flights to the sun</p></div><p>No ship left the harbour for nine days.</p>"
        "<div class='related-articles'><h3>Related</h3><ul><li><a>Calm seas</a></li></ul></div></div>",
        ["Storm", "The storm came from the west and stayed.", "No ship left the harbour for nine days."],
    ),
    "scripts in the middle": (
        "<article><h1>Wells</h1><p>The well was dug by hand.<script>if (a < b) { document.write('<p>ad</p>'); }</script></p><style>p { color: red }</style><noscript><p>Turn scripts on</p></noscript><p>It is dry now.</p></article>",
        ["Wells", "The well was dug by hand.", "It is dry now."],
    ),
    "breadcrumbs and share bar": (
        "<body><ul class='breadcrumb'><li><a>Home</a></li><li><a>Nature</a></li></ul><article><h1>Otters</h1><div class='share-buttons'><a>Tweet</a><a>Mail</a></div><p>Otters have come back to the upper river.</p></article><div class='pagination'><a>1</a> <a>2</a></div></body>",
        ["Otters", "Otters have come back to the upper river."],
    ),
    'social article': (
        "<article class='post social'><h1>Mills</h1><p>The mill stands where the two brooks meet.</p><p>It has not ground corn since the war.</p></article>",
        ['Mills', 'The mill stands where the two brooks meet.', 'It has not ground corn since the war.'],
    ),
    'social article short': (
        '<article class="post social"><p>The mill stands where the two brooks meet.</p><p>It has not ground corn since the war.</p></article>',
        ['The mill stands where the two brooks meet.', 'It has not ground corn since the war.'],
    ),
    'reactions': (
        '<article><h1>Mills</h1><p>The mill stands where the two brooks meet.</p></article><section id=reactions><div class=reaction><b>bob</b><p>Great read, I had no idea of it.</p></div></section>',
        ['Mills', 'The mill stands where the two brooks meet.'],
    ),
    'reactions two': (
        '<article><h1>Mills</h1><p>The mill stands where the two brooks meet.</p></article><section id=reactions><div class=reaction><b>bob</b><p>Great read.</p></div><div class=reaction><b>ann</b><p>I was there as a child, it is all true.</p></div></section>',
        ['Mills', 'The mill stands where the two brooks meet.'],
    ),
    'bare': (
        '<html><body><h1>Mills</h1><p>The mill stands where the two brooks meet.</p><p>It has not ground corn since the war.</p></body></html>',
        ['Mills', 'The mill stands where the two brooks meet.', 'It has not ground corn since the war.'],
    ),
    'bare div': (
        '<div><h1>Mills</h1><p>The mill stands where the two brooks meet.</p><p>It has not ground corn since the war.</p></div>',
        ['Mills', 'The mill stands where the two brooks meet.', 'It has not ground corn since the war.'],
    ),
}


@pytest.fixture(scope="module")
def trained(spark):
    return html_extraction.fit(spark.read.parquet(f"{SF}/pages.parquet"), "html", 150, 600)


def test_pages_written_by_hand(trained):
    wrong, total, whole = [], 0, 0
    for name, (page, want) in PAGES.items():
        found = blocks.leaves(page)
        kept = trained.main_texts([found]).pop().split("\n")
        total += len(found)
        mistakes = [("lost", x) for x in want if x not in kept] + [("kept", x) for x in kept if x not in want]
        whole += kept == want
        wrong += [(name, *m) for m in mistakes]
    print(f"{total - len(wrong)} of {total} blocks, {whole} of {len(PAGES)} pages", wrong)
    assert len(wrong) <= 0.06 * total, wrong
    first = [n for n in PAGES if n.startswith(("image", "break", "controls", "social", "reactions", "bare"))]
    assert not [w for w in wrong if w[0] in first]
