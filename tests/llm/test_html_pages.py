"""Pages written by hand, with the text a reader would call the article."""

import pytest

from tastemill.llm.html_blocks import main_text

PROSE = "The people of the town went to the river in the morning, and it was there that they found the boat which had been lost for so long."
MORE = "It is said that the boat was built by one of the oldest families, but no one in the town could tell what had become of them since."
NAV = "<nav><ul><li><a href=/>Home</a><li><a href=/news>News</a></ul></nav>"
FOOT = "<footer><p>Copyright of the owners. All of the rights are reserved by the publisher of this page and by its authors.</p></footer>"
NOTICE = "We use cookies to make the use of this site better for all of the readers and to see how it is used by them in the course of a day."
BOTH = f"{PROSE}\n\n{MORE}"
BODY = f"<p>{PROSE}</p><p>{MORE}</p>"
POLISH = "Mieszkańcy miasta poszli rano nad rzekę i właśnie tam znaleźli łódź, która zaginęła wiele lat temu, choć nikt nie wiedział dokładnie, kiedy się to stało."
FINNISH = "Kaupungin asukkaat menivät aamulla joelle ja löysivät sieltä veneen, joka oli ollut kadoksissa jo monta vuotta, vaikka kukaan ei tiennyt miten se katosi."
RUSSIAN = "Жители города пошли утром к реке и именно там нашли лодку, которая пропала много лет назад, хотя никто точно не знал, когда это случилось на самом деле."
GERMAN = "Die Leute der Stadt gingen am Morgen zu dem Fluss, und es war dort, dass sie das Boot fanden, das seit so langer Zeit nicht mehr gesehen worden war."
FRENCH = "Les gens de la ville sont partis le matin vers la rivière, et c'est là qu'ils ont trouvé le bateau qui était perdu depuis si longtemps dans les bois."
SPANISH = "La gente de la ciudad fue por la mañana al río, y fue allí que se encontró el barco que se había perdido en el bosque hace tanto tiempo por los niños."

PAGES = [
    # Names that say what a page has, not what an element is.
    (f'<article class="post comments-open">{BODY}</article>', BOTH),
    (f'<div class="content with-sidebar">{BODY}</div>', BOTH),
    (f'<div class="site has-header"><main>{BODY}</main></div>', BOTH),
    (f'<section class="search-results">{BODY}</section>', BOTH),
    (f'<article><p class="share-price">{PROSE}</p><p>{MORE}</p></article>', BOTH),
    (f'<body class="no-sidebar header-fixed"><div class="entry">{BODY}</div></body>', BOTH),
    (f'<div class="advertisement-free">{BODY}</div>', BOTH),
    (f'<div id="promotion-of-science">{BODY}</div>', BOTH),
    # An article within furniture by name, and names that mislead altogether.
    (f'<div class="widget"><article>{BODY}</article></div>', BOTH),
    (f'<div class="header"><div role="main">{BODY}</div></div>', BOTH),
    (f'<div class="banner">{BODY}</div>', BOTH),
    # Furniture, by name and by tag.
    (f'{NAV}<article>{BODY}</article>{FOOT}', BOTH),
    (f'{NAV}<div class="story">{BODY}</div>{FOOT}', BOTH),
    (f'<div class="cookie-notice"><p>{NOTICE}</p></div><div>{BODY}</div>', BOTH),
    (f'<div id="gdpr_consent">{NOTICE}</div><main>{BODY}</main>', BOTH),
    (f'<main>{BODY}</main><section class="comments"><article class="comment"><p>{NOTICE}</p></article></section>', BOTH),
    (f'<main>{BODY}<div class="comment-list"><p>{NOTICE}</p></div></main>', BOTH),
    (f'<main>{BODY}<div class="related-posts"><p>{NOTICE}</p></div></main>', BOTH),
    (f'<div>{BODY}</div><div class="share-buttons"><a>share</a> <a>like</a></div>', BOTH),
    (f'<div class="sidebar left"><p>{NOTICE}</p></div><div>{BODY}</div>', BOTH),
    (f'<div>{BODY}</div><aside><article>{NOTICE}</article></aside>', BOTH),
    (f'<div>{BODY}</div><form class="newsletter-box"><p>{NOTICE}</p></form>', BOTH),
    (f'<article>{BODY}<div class="ad-slot">{NOTICE}</div></article>', BOTH),
    (f"{NAV}{FOOT}", ""),
    # Scripts, references, broken markup.
    (f"<script>var p = '<p>{NOTICE}</p>';</script><style>p {{}}</style><div>{BODY}</div>", BOTH),
    (f"<article><p>{PROSE.replace('river', 'r&iacute;ver &amp; lake')}</article>", PROSE.replace("river", "ríver & lake")),
    (f"<article><h1>The boat</h1><p>{PROSE}<p>{MORE}", f"The boat\n\n{BOTH}"),
    # Other languages, with and without stop words that are known.
    (f"{NAV}<div><p>{GERMAN}</p></div>", GERMAN),
    (f"{NAV}<div><p>{FRENCH}</p></div>", FRENCH),
    (f"{NAV}<div><p>{SPANISH}</p></div>", SPANISH),
    (f"{NAV}<div><p>{POLISH}</p></div>{FOOT}", POLISH),
    (f"{NAV}<div><p>{FINNISH}</p></div>", FINNISH),
    (f"{NAV}<div><p>{RUSSIAN}</p></div>", RUSSIAN),
    (f"{NAV}<article><p>{POLISH}</p></article>", POLISH),
    # A list of words is no prose.
    (f"<div>{'alpha beta gamma delta ' * 20}</div><div>{BODY}</div>", BOTH),
]


@pytest.mark.parametrize("page", range(len(PAGES)))
def test_page(page):
    html, text = PAGES[page]
    assert main_text(f"<html><head><title>no</title></head><body>{html}</body></html>" if "<body" not in html else html) == text
