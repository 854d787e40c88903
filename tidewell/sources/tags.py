"""Fixed values about HTML that the readers of pages share."""

# Tags without content, tags that are not read, tags that end an open paragraph.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
UNREAD = (
    "script style noscript iframe svg template head nav footer aside form button select figure figcaption picture video audio canvas dialog"
).split()
ENDS_PARAGRAPH = "p div section article ul ol li h1 h2 h3 h4 table blockquote".split()
# Class names and first words of what is not part of an article, class names of its body.
ASIDE_NAME = (
    r"(?i)(comment|share|social|related|relacionad|newsletter|promo|banner|advert|publicidad|sidebar|menu|"
    r"breadcrumb|\btags?\b|paywall|subscri|suscri|widget|recomend|more-?news|taboola|outbrain|"
    r"author-?bio|footer|cookie|popup|modal|signup|follow|whatsapp|telegram)"
)
ASIDE_TEXT = (
    r"(?i)^(lee tambien|lea tambien|te puede interesar|mira tambien|puede interesarte|mas informacion|"
    r"suscribete|suscribase|siguenos|sigue a|compartir|comparte|publicidad|advertisement|"
    r"recibe las noticias|unete a|descarga la app|lo mas leido|tambien lee|no te pierdas|"
    r"foto:|imagen:|video:|fuente:|click aqui|haz clic|escucha|ver mas|lee mas)\b"
)
BODY_NAME = (
    r"(?i)(articlebody|article-body|story-contents|story-body|entry-content|post-content|"
    r"nota-contenido|contenido-nota|article__body|article-content|body-content|"
    r"cuerpo|content-body|field--name-body|detail-body|news-body)"
)
# Tags of containers that a class name may mark as an article's body, tags that a class name may mark as no part of it.
BODY_TAGS = "div section article main".split()
ASIDE_TAGS = "div section ul ol p span".split()
# Metadata that may hold the date, in order; other places of it in the first letters of a page.
DATE_NAMES = "article:published_time datepublished publishdate pubdate date dc.date.issued sailthru.date og:published_time".split()
DATE_SHOWN = ['(?i)"datePublished"\\s*:\\s*"([^"]+)"', "(?i)<time[^>]+datetime\\s*=\\s*[\"']([^\"']+)[\"']"]
DATE_LETTERS = 60000
# Lengths of a paragraph by tag; shortest main text, article body in JSON-LD, paragraph of a whole page; shortest one that tells where the text is.
LENGTHS = {"p": (40, None), "blockquote": (40, None), "div": (60, None), "li": (80, None), "h2": (20, 160), "h3": (20, 160)}
MAIN_TEXT, LD_TEXT, LAST_RESORT, TELLING = 250, 200, 30, 60
# What a paragraph in a div may hold.
INLINE = "a b i strong em span br".split()
# For lines and links of a page, tags that end a line; headings.
LINE_TAGS = (
    "p div li br tr td th h1 h2 h3 h4 h5 h6 section article address ul ol table footer header nav main aside form dd dt option"
).split()
HEADINGS = ["h1", "h2", "h3", "h4"]
