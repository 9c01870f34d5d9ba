"""Pages written by hand in layouts that the training pages do not have, each with its main text."""

PAGES = [
    # Tables for the layout, no classes or ids.
    (
        """<html><body bgcolor=white><table width=100%><tr><td colspan=2><a href=/>Start</a> | <a href=/map>Map</a> | <a href=/mail>Mail</a></td></tr>
<tr><td width=150><a href=/1>One</a><br><a href=/2>Two</a><br><a href=/3>Three</a></td><td>
<h1>The lighthouse at the cape</h1><p>The tower was built of grey stone in the spring of that year, and the keeper moved in before its lamp had ever burned.</p>
<p>For forty winters nobody else lived on the cape, and the road was open for three months of the twelve.</p></td></tr>
<tr><td colspan=2><small>Copyright 2011. All rights reserved. <a href=/terms>Terms</a></small></td></tr></table></body></html>""",
        ["The lighthouse at the cape", "The tower was built of grey stone in the spring of that year, and the keeper moved in before its lamp had ever burned.", "For forty winters nobody else lived on the cape, and the road was open for three months of the twelve."],
    ),
    # Sections with nested comments.
    (
        """<!doctype html><html><head><title>Bread</title><style>p{margin:0}</style></head><body><header><h2>Kitchen notes</h2><nav><a href="/a">Recipes</a><a href="/b">Tools</a></nav></header>
<main><section><h1>Bread without kneading</h1><p>Mix flour, water and salt in the evening and leave the bowl covered on the table until the next morning.</p><p>In the morning fold the dough twice, let it rest for an hour and bake it in a closed pot.</p></section>
<section class="comments"><h3>3 comments</h3><div class="comment"><p>Great, I tried this and it worked!</p><div class="reply"><p>Same here, thank you.</p></div></div></section></main>
<aside><h4>Popular</h4><ul><li><a href="/c">Soup</a></li><li><a href="/d">Cake</a></li></ul></aside><footer><p>Contact us | Imprint</p></footer></body></html>""",
        ["Bread without kneading", "Mix flour, water and salt in the evening and leave the bowl covered on the table until the next morning.", "In the morning fold the dough twice, let it rest for an hour and bake it in a closed pot."],
    ),
    # Plain divisions with other names, a form and a notice.
    (
        """<html><body><div id="top"><a href="/">Logo</a></div><div id="cookie-banner"><p>We use cookies. <button>Accept</button></p></div><div id="wrap"><div id="leftcol"><form action="/s"><input name=q><button>Search</button></form><p>Sponsored: buy cheap shoes today.</p></div>
<div id="story"><h1>Rain returns to the valley</h1><p>After nine dry weeks the first clouds came over the western ridge on Sunday, and by night the streams were full again.</p><blockquote>We had stopped counting the days, said one of the farmers.</blockquote><ul><li>The upper fields took no damage at all.</li><li>Two small bridges were closed for a day.</li></ul><p>The weather service expects more rain in the coming week.</p></div></div><div id="bottom"><a href="/p">Privacy</a> <a href="/i">Imprint</a></div></body></html>""",
        ["Rain returns to the valley", "After nine dry weeks the first clouds came over the western ridge on Sunday, and by night the streams were full again.", "We had stopped counting the days, said one of the farmers.", "The upper fields took no damage at all.", "Two small bridges were closed for a day.", "The weather service expects more rain in the coming week."],
    ),
    # Old markup without closing tags.
    (
        """<HTML><BODY><H1>How tides work</H1><P>The moon pulls the water on the near side more strongly than the earth beneath it, and so a bulge of water forms.<P>On the far side a second bulge forms, for there the pull is weaker than on the earth as a whole.<P>Between the two the sea is low.<HR><A HREF="index.html">Back to index</A> <A HREF="next.html">Next page</A></BODY></HTML>""",
        ["How tides work", "The moon pulls the water on the near side more strongly than the earth beneath it, and so a bulge of water forms.", "On the far side a second bulge forms, for there the pull is weaker than on the earth as a whole.", "Between the two the sea is low."],
    ),
]
