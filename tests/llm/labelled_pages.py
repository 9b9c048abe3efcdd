"""Pages written by hand in layouts that the generated training pages don't have; ``[[`` and ``]]`` enclose main text."""

PAGES = {
    "old table layout": """<html><head><title>Harbour news</title></head><body bgcolor=#ffffff><table width=800><tr><td colspan=2><a href="/">Home</a> | <a href="/a">Archive</a> | <a href="/c">Contact</a></td></tr>
<tr><td width=150 valign=top><font size=1><a href="/1">Weather</a><br><a href="/2">Tides</a><br><a href="/3">Ferries</a><br><a href="/4">Jobs</a></font></td>
<td valign=top>[[<h2>New crane for the harbour</h2><font face=Arial>The harbour board bought a second crane on Monday, after two years of talks about its price.<br><br>It can lift forty tonnes and will be set up beside the fish hall in spring.<br>Work on the base has begun, and the quay will be closed at night until May.</font>]]</td></tr>
<tr><td colspan=2><font size=1>Copyright 2003 Harbour Press. All rights reserved.</font></td></tr></table></body></html>""",
    "breaks only": """<body><a href="/">home</a> <a href="/log">log</a> <a href="/links">links</a><hr>[[<b>Trip to the lake</b><br>We left at six, when it was still dark, and walked along the old railway for two hours.<br>
At the lake the fog was so thick that we could not see the boat.<br><br>Anna made coffee on the stones. We stayed until noon, then took the bus back from the village.]]<hr><a href="/prev">previous</a> <a href="/next">next</a></body>""",
    "nested comments": """<div id="wrap"><div id="top"><a href=/>Blog</a><ul><li><a href=/about>About</a><li><a href=/rss>RSS</a></ul></div><div class="post-body">[[<h1>Why the queue was slow</h1><p>For a week every job waited about a minute before it ran. We looked at the scheduler first, then at the disks, and found nothing.</p>
<p>In the end it was a lock in the logger. One process held it while it rotated files, and everyone else stood in line.</p><p>The fix was one line, and the queue is empty again.</p>]]</div>
<ol class="commentlist"><li><div class="comment-author">Jo</div><p>We had the very same thing last year, it took us a month to find out.</p><ol><li><div class="comment-author">Ann</div><p>A month? How did you notice at all that the logger was at fault there?</p><ol><li><p>By luck, a colleague attached a debugger to the wrong process.</p></li></ol></li></ol></li><li><p>Thanks for writing this up, very helpful.</p></li></ol><div id="respond"><form><textarea>Your reply</textarea></form></div></div>""",
    "cyrillic": """<html><body><div class="menu"><a href="/">Главная</a> <a href="/n">Новости</a> <a href="/k">Контакты</a></div><div class="text">[[<h1>Мост открыли после ремонта</h1><p>Вчера вечером в городе открыли старый мост через реку, который ремонтировали почти два года.</p><p>По словам инженеров, опоры укрепили, а дорогу сделали шире. Теперь по мосту снова ходят трамваи, и жители могут быстрее добраться до центра.</p>]]</div><div class="footer">© 2021 Городская газета. Все права защищены.</div></body></html>""",
    "chinese": """<html><body><ul class="nav"><li><a href="/">首页</a></li><li><a href="/x">新闻</a></li><li><a href="/y">体育</a></li></ul><div id="article">[[<h1>城市图书馆周末开放</h1><p>市图书馆宣布，从下个月起，周末的开放时间将延长到晚上九点，方便读者借阅图书。</p><p>馆长表示，新的阅览室有三百个座位，学生可以免费使用电脑和打印机。</p>]]</div><div class="copyright">版权所有 不得转载</div></body></html>""",
    "arabic": """<html dir=rtl><body><nav><a href="/">الرئيسية</a><a href="/s">رياضة</a></nav><main>[[<h1>افتتاح الحديقة الجديدة</h1><p>افتتحت البلدية صباح اليوم حديقة جديدة في وسط المدينة، وفيها ملعب للأطفال ومكان للقراءة.</p><p>وقال المسؤول إن العمل استمر عاما كاملا، وإن الدخول سيكون مجانا لجميع السكان.</p>]]</main><footer>جميع الحقوق محفوظة</footer></body></html>""",
    "documentation": """<body><div class="sphinxsidebar"><h3>Contents</h3><ul><li><a href=#a>Install</a></li><li><a href=#b>Use</a></li><li><a href=#c>Reference</a></li></ul><form class="search"><input name=q></form></div><div class="document"><div class="body" role="main">[[<h1>Using the reader</h1><p>The reader opens a file and gives its rows one at a time. It closes the file when the last row was read, or when you leave the block.</p><pre>for row in Reader("a.txt"):
    print(row)</pre><p>Rows are lists of strings; empty fields are empty strings and never missing.</p><table><tr><th>Option</th><th>Meaning</th></tr><tr><td>sep</td><td>what separates the fields</td></tr><tr><td>skip</td><td>how many rows to leave out at the start</td></tr></table>]]</div></div><div class="footer">Created with a generator.</div></body>""",
    "recipe": """<body><header><a href="/">Kitchen</a><nav><ul><li><a href="/s">Soups</a></li><li><a href="/c">Cakes</a></li></ul></nav></header><div class="ad">Buy our knives now and save half</div><article>[[<h1>Leek soup</h1><p>A simple soup for cold days, ready in half an hour.</p><h2>You need</h2><ul><li>two leeks</li><li>three potatoes</li><li>a litre of stock</li><li>salt and pepper</li></ul><h2>How to</h2><ol><li>Wash the leeks, cut them into rings and fry them gently in butter.</li><li>Add the potatoes and the stock, and cook for twenty minutes.</li><li>Blend, season and serve with bread.</li></ol>]]<div class="share">Share this on every network you know</div></article><aside><h3>More recipes</h3><ul><li><a href=/1>Onion tart</a></li><li><a href=/2>Bean stew</a></li></ul></aside><footer>Imprint Privacy Contact</footer></body>""",
    "no hints": """<body><div><div><a href="/">Start</a></div><div><a href="/a">Products</a></div><div><a href="/b">Prices</a></div><div><a href="/c">Help</a></div></div><div><div>[[<div><span>The valley in winter</span></div><div>Snow fell for nine days. On the tenth morning the road to the pass was open again, and the first carts came through before noon.</div><div>Nobody had been ill, and there was bread enough, but the post had piled up in the town below and needed two sledges.</div>]]</div></div><div><a href="/i">Imprint</a> <a href="/p">Privacy</a> <a href="/t">Terms</a></div></body>""",
    "cookie wall and related": """<body><div id="consent-banner"><p>We and our partners use cookies to show you things that you may like, and to measure how you use this site.</p><button>Accept all</button><button>Choose</button></div><div class="site"><div class="masthead"><a href=/>The Daily</a></div><section class="story">[[<h1>Bakers go on strike</h1><p>Most bakeries in the north stayed closed on Friday. The bakers ask for a shorter night shift and for pay on holidays.</p>]]<div class="related-box"><h4>Related</h4><a href=/1>Mills to merge</a><a href=/2>Price of flour up again</a></div>[[<p>Talks will go on next week, said the union. The owners did not want to comment, but one of them called the demands fair.</p>]]</section><div class="newsletter"><p>Get our best stories in your mail every morning.</p><form><input type=email><button>Sign up</button></form></div></div></body>""",
    "forum question": """<body><div class="topbar"><a href=/>Questions</a> <a href=/t>Tags</a> <a href=/u>Users</a></div><div id="question"><div class="post-text">[[<h1>How do I keep bread fresh?</h1><p>I bake on Sundays and the loaf is hard by Wednesday. I keep it in a paper bag in the kitchen, which is rather warm.</p><p>Is a clay pot better, or should I freeze half of it at once?</p>]]</div></div><div id="comments"><div class="comment"><p>Freeze it, sliced, that works for us.</p></div><div class="comment"><p>What flour do you use? Rye keeps longer.</p></div></div><div id="sidebar"><h4>Hot topics</h4><ul><li><a href=/1>Sharp knives</a></li><li><a href=/2>Old pans</a></li></ul></div></body>""",
    "broken markup": """<div class=content>[[<h1>Notes on clocks<p>The first clock stopped in the war <i>and nobody wound it since.<p>The second one <b>gains a minute a day, which is not bad</i> for its age.</b><ul><li>face: oak<li>hands: brass</ul><p>Both are for sale, but not to dealers.]]</div><div class=footer>&copy; Clock house <a href=/x>Imprint</div>""",
    "long article with captions": """<body><nav class="crumbs"><a href=/>World</a> &gt; <a href=/e>Europe</a></nav><main><article itemprop="articleBody">[[<h1>The last lighthouse keeper</h1><p>When Erik came to the island he was twenty-two and wanted to stay for a summer. He stayed for forty years.</p><figure><img src=a.jpg><figcaption>The tower before the storm of 1987.</figcaption></figure><p>Each evening he climbed the stairs, cleaned the lens and lit the lamp, and each morning he put it out. In between he read, wrote to his sister and mended nets.</p><blockquote>It was never lonely, he says. The sea talks all the time.</blockquote><p>Now a machine does his work. Erik lives in the village, but on clear nights he still looks up at ten, to see whether it is on time.</p>]]</article></main><footer><ul><li><a href=/a>About us</a></li><li><a href=/j>Jobs</a></li></ul><p>All content is protected by law.</p></footer></body>""",
    "nothing but links": """<body><div class="nav"><a href=/1>One</a> <a href=/2>Two</a></div><ul><li><a href=/3>Page three of the list</a></li><li><a href=/4>Page four of the list</a></li></ul><div class="footer"><a href=/5>Imprint</a></div></body>""",
}


def split(page: str) -> tuple[str, str]:
    """The page without marks, and its marked markup."""
    main = "".join(x.split("]]")[0] + "\n" for x in page.split("[[")[1:])
    return page.replace("[[", "").replace("]]", ""), main
