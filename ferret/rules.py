"""Keyword lists, URL lists and thresholds used by the page rules.

Every operator takes these as parameters; the module-level values are the
defaults. They are FIXED VALUES: they must equal the crawler's own lists so that
rule outcomes are the same, so they are written out plainly, in their original
order, and must not be edited for any other reason.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (start URLs)
# ---------------------------------------------------------------------------

DEFAULT_START_URLS_BROAD = [
    "https://github.com/topics/python",
    "https://stackoverflow.com/questions/tagged/python",
    "https://dev.to/t/python",
    "https://www.reddit.com/r/Python/",
    "https://www.geeksforgeeks.org/python-programming-language/",
    "https://realpython.com/tutorials/all/",
    "https://www.w3schools.com/python/",
    "https://docs.python.org/3/tutorial/",
    "https://reactjs.org/docs/getting-started.html",
    "https://github.com/topics/react",
    "https://stackoverflow.com/questions/tagged/reactjs",
    "https://dev.to/t/react",
    "https://www.reddit.com/r/reactjs/",
    "https://www.w3schools.com/react/",
    "https://reactjs.org/docs/hooks-intro.html",
    "https://reactjs.org/docs/hooks-overview.html",
    "https://reactjs.org/docs/hooks-state.html",
    "https://reactjs.org/docs/hooks-effect.html",
    "https://www.tutorialspoint.com/cobol/index.htm",
    "https://www.mainframestechhelp.com/tutorials/cobol/",
    "https://www.ibm.com/docs/en/cobol-zos",
    "https://www.tutorialspoint.com/fortran/index.htm",
    "https://fortran-lang.org/learn/",
    "https://github.com/topics/fortran",
]

DEFAULT_START_URLS_DISTRIBUTED = [
    "https://github.com/topics/python",
    "https://stackoverflow.com/questions/tagged/python",
    "https://dev.to/t/python",
    "https://www.reddit.com/r/Python/",
    "https://www.geeksforgeeks.org/python-programming-language/",
    "https://realpython.com/tutorials/all/",
    "https://www.w3schools.com/python/",
    "https://docs.python.org/3/tutorial/",
    "https://reactjs.org/docs/getting-started.html",
    "https://github.com/topics/react",
    "https://stackoverflow.com/questions/tagged/reactjs",
    "https://dev.to/t/react",
    "https://www.reddit.com/r/reactjs/",
    "https://www.w3schools.com/react/",
    "https://reactjs.org/docs/hooks-intro.html",
    "https://reactjs.org/docs/hooks-overview.html",
    "https://reactjs.org/docs/hooks-state.html",
    "https://reactjs.org/docs/hooks-effect.html",
    "https://javascript.info/",
    "https://developer.mozilla.org/en-US/docs/Web/JavaScript",
    "https://www.w3schools.com/js/",
    "https://github.com/topics/programming",
    "https://news.ycombinator.com/",
    "https://dev.to/",
]

# Search-page templates for a query. "{q}" is the raw query text and
# "{q_lower}" its lower-case form.
QUERY_URL_TEMPLATES = [
    "https://github.com/topics/{q}",
    "https://stackoverflow.com/questions/tagged/{q}",
    "https://stackoverflow.com/search?q={q}",
    "https://dev.to/t/{q}",
    "https://dev.to/search?q={q}",
    "https://medium.com/search?q={q}",
    "https://www.geeksforgeeks.org/search/{q}",
    "https://www.freecodecamp.org/news/search/?query={q}",
    "https://www.digitalocean.com/community/tutorials?q={q}",
    "https://realpython.com/search?q={q}",
    "https://www.tutorialspoint.com/index.htm?search={q}",
    "https://www.tutorialspoint.com/{q}/index.htm",
    "https://hackernoon.com/search?query={q}",
    "https://substack.com/search?q={q}",
    "https://docs.python.org/3/search.html?q={q}",
    "https://developer.mozilla.org/en-US/search?q={q}",
    "https://www.w3schools.com/search/search.php?q={q}",
    "https://ibm.github.io/mainframe-downloads/search.html?q={q}",
    "https://docs.oracle.com/search/?q={q}",
    "https://learn.microsoft.com/en-us/search/?terms={q}",
    "https://www.ibm.com/search?q={q}",
    "https://www.google.com/search?q={q}+programming+tutorial",
    "https://www.google.com/search?q={q}+programming+guide",
    "https://www.google.com/search?q={q}+coding+tutorial",
    "https://www.google.com/search?q={q}+programming+examples",
    "https://www.google.com/search?q={q}+language+tutorial",
    "https://www.google.com/search?q={q}+programming+book",
    "https://www.google.com/search?q={q}+documentation",
    "https://www.google.com/search?q=learn+{q}+programming",
    "https://www.google.com/search?q=best+{q}+resources",
    "https://www.google.com/search?q={q}+implementation",
    "https://www.google.com/search?q={q}+language+specification",
    "https://www.google.com/search?q={q}+code+examples",
    "https://www.google.com/search?q={q}+reference+manual",
    "https://www.google.com/search?q={q}+programming+language",
    "https://www.google.com/search?q={q}+compiler",
    "https://www.google.com/search?q={q}+interpreter",
    "https://www.google.com/search?q=what+is+{q}",
    "https://www.google.com/search?q={q}+history",
    "https://www.google.com/search?q={q}+vs",
    "https://www.google.com/search?q={q}",
    "https://www.bing.com/search?q={q}+programming+guide",
    "https://www.bing.com/search?q={q}+programming",
    "https://duckduckgo.com/?q={q}+programming",
    "https://duckduckgo.com/?q={q}",
    "https://search.brave.com/search?q={q}+programming",
    "https://search.brave.com/search?q={q}",
    "https://www.startpage.com/do/search?q={q}+programming",
    "https://www.qwant.com/?q={q}+programming",
    "https://www.mojeek.com/search?q={q}+programming",
    "https://search.yahoo.com/search?p={q}+programming",
    "https://www.reddit.com/search/?q={q}+programming",
    "https://www.reddit.com/r/learnprogramming/search/?q={q}",
    "https://www.reddit.com/r/programming/search/?q={q}",
    "https://news.ycombinator.com/item?id=search&q={q}",
    "https://forums.oracle.com/ords/apexds/domain/dev-community/search?search={q}",
    "https://community.ibm.com/community/user/search?query={q}",
    "https://stackoverflow.blog/?s={q}",
    "https://discuss.codecademy.com/search?q={q}",
    "https://talk.automators.fm/search?q={q}",
    "https://www.youtube.com/results?search_query={q}+programming+tutorial",
    "https://www.youtube.com/results?search_query={q}+tutorial",
    "https://www.youtube.com/results?search_query=learn+{q}",
    "https://vimeo.com/search?q={q}+programming",
    "https://ocw.mit.edu/search/?q={q}",
    "https://www.coursera.org/search?query={q}",
    "https://www.khanacademy.org/search?page_search_query={q}",
    "https://www.edx.org/search?q={q}",
    "https://www.udemy.com/courses/search/?src=ukw&q={q}",
    "https://www.udacity.com/courses/all?search={q}",
    "https://online-learning.harvard.edu/search-classes/{q}",
    "https://online.stanford.edu/search-catalog/{q}",
    "https://legacy.cplusplus.com/search.do?q={q}",
    "https://en.cppreference.com/mwiki/index.php?title=Special%3ASearch&search={q}",
    "https://www.sourcecodesworld.com/source/search.asp?key={q}",
    "https://sourceforge.net/directory/?q={q}",
    "https://mvnrepository.com/search?q={q}",
    "https://devdocs.io/#q={q}",
    "https://hackage.haskell.org/packages/search?terms={q}",
    "https://crates.io/search?q={q}",
    "https://www.npmjs.com/search?q={q}",
    "https://pypi.org/search/?q={q}",
    "https://rubygems.org/search?query={q}",
    "https://packagist.org/?query={q}",
    "https://www.microfocus.com/search?q={q}",
    "https://www.mainframestechhelp.com/search-results?query={q}",
    "https://www.ibm.com/search?lang=en&cc=us&q={q}",
    "https://fortran-lang.org/search/?q={q}",
    "https://www.ibm.com/docs/en/search/{q}",
    "https://www.tutorialspoint.com/{q_lower}/index.htm",
    "https://scholar.google.com/scholar?q={q}+programming",
    "https://arxiv.org/search/?query={q}&searchtype=all",
    "https://dl.acm.org/action/doSearch?AllField={q}",
    "https://ieeexplore.ieee.org/search/searchresult.jsp?queryText={q}",
    "https://www.sciencedirect.com/search?qs={q}",
    "https://link.springer.com/search?query={q}",
    "https://pubmed.ncbi.nlm.nih.gov/?term={q}+programming",
    "https://books.google.com/books?q={q}+programming",
    "https://archive.org/search?query={q}%20programming",
    "https://www.pdfdrive.com/search?q={q}+programming",
    "https://openlibrary.org/search?q={q}+programming",
    "https://www.gutenberg.org/ebooks/search/?query={q}",
    "https://www.oreilly.com/search/?query={q}",
    "https://www.manning.com/search?q={q}",
    "https://www.packtpub.com/search?query={q}",
    "https://en.wikipedia.org/w/index.php?search={q}+programming+language",
    "https://wiki.c2.com/?SearchResults&search={q}",
    "https://www.wikiwand.com/?search={q}",
    "https://rosettacode.org/w/index.php?search={q}",
    "https://alternativeto.net/browse/search?q={q}",
    "https://lobste.rs/search?q={q}&what=stories&order=relevance",
]

# ---------------------------------------------------------------------------
# FIXED VALUES (broad link rule)
# ---------------------------------------------------------------------------

ARCHIVE_EXTENSIONS = [".zip", ".tar", ".gz", ".rar", ".exe", ".dmg", ".iso"]

FOLLOW_PRIORITY_DOMAINS = [
    "github.com", "stackoverflow.com", "dev.to", "medium.com",
    "freecodecamp.org", "realpython.com", "digitalocean.com",
    "tutorialspoint.com", "w3schools.com", "mozilla.org", "youtube.com",
    "reddit.com", "hackernews.com", "substack.com", "docs.google.com",
    "kubernetes.io", "docker.com", "python.org", "reactjs.org",
    "angular.io", "vuejs.org", "rust-lang.org", "golang.org",
    "developer.mozilla.org", "aws.amazon.com", "cloud.google.com",
    "docs.microsoft.com", "graphql.org", "postgresql.org", "mysql.com",
    "ibm.com", "mainframestechhelp.com", "microfocus.com", "borland.com",
    "fortran-lang.org", "cobol.com", "mainframegurukul.com", "cobolforgcc.com",
    "clarabridge.com", "netcobol.com", "ibm.github.io", "legacy.cplusplus.com",
    "sourcecodesworld.com", "findbestopensource.com", "alternet.cobol.com",
    "opencobol.org", "fujitsu.com", "visualcobol.net", "jics.macc.wisc.edu",
    "fortranplus.co.uk", "netlib.org", "fortran.com", "gfortran.com",
    "j3-fortran.org", "gcc.gnu.org", "cse.yorku.ca",
    "scholar.google.com", "arxiv.org", "dl.acm.org", "ieeexplore.ieee.org",
    "academia.edu", "researchgate.net", "mit.edu", "stanford.edu",
    "berkeley.edu", "cam.ac.uk", "ox.ac.uk", "harvard.edu", "princeton.edu",
    "devdocs.io", "readthedocs.io", "docs.oracle.com", "wikiwand.com",
    "cppreference.com", "manual.com", "docs.rs", "dartdocs.org",
    "apidock.com", "jsdoc.app", "kotlinlang.org", "scaladoc.org",
    "oreilly.com", "manning.com", "packtpub.com", "informit.com",
    "apress.com", "wiley.com", "springer.com", "pragprog.com",
    "edx.org", "coursera.org", "udemy.com", "pluralsight.com",
    "khanacademy.org", "codecademy.com", "udacity.com",
    "hashnode.com", "lobste.rs", "slashdot.org", "infoq.com",
    "codingforums.com", "quora.com", "sitepoint.com", "dzone.com",
]

PROGRAMMING_PATHS = [
    "developer", "programming", "tutorial", "guide", "learn",
    "course", "documentation", "reference", "manual", "handbook",
    "example", "sample", "snippet", "howto", "language", "framework",
    "library", "package", "module", "function", "class", "method",
    "interface", "api", "sdk", "code", "development", "software",
    "engineering", "computer-science", "tech", "algorithm", "cobol",
    "fortran", "mainframe", "legacy", "vintage-computing",
]

IRRELEVANT_PATTERNS = ["checkout", "payment", "unsubscribe"]

# ---------------------------------------------------------------------------
# FIXED VALUES (broad resource-page rule)
# ---------------------------------------------------------------------------

# Queries for which a page with two or more mentions is a resource.
LEGACY_DENSE_QUERIES = ["cobol", "fortran", "pascal", "basic", "ada", "lisp",
                        "prolog", "smalltalk", "mainframe"]

# Structure signals. Each entry is (kind, value):
#   ("tag", t)            an element <t>
#   ("class", c)          an element whose class list holds the token c
#   ("id", i)             an element with id i
#   ("heading", (h, w))   a <h> element whose own text, lower-cased, contains w
#   ("class_has", (t, s)) a <t> element whose class attribute contains s
STRUCTURE_SIGNALS_BROAD = [
    ("tag", "pre"), ("tag", "code"),
    ("class", "highlight"), ("class", "code"),
    ("class", "CodeMirror"), ("class", "ace_editor"),
    ("class", "program"), ("class", "syntax"),
    ("class", "markdown-body"), ("class", "documentation"),
    ("class", "api-docs"), ("class", "reference"),
    ("class", "man-page"), ("class", "docstring"),
    ("class", "manual"), ("class", "handbook"),
    ("heading", ("h1", "guide")),
    ("heading", ("h1", "tutorial")),
    ("heading", ("h1", "how to")),
    ("heading", ("h2", "tutorial")),
    ("heading", ("h2", "guide")),
    ("heading", ("h2", "introduction")),
    ("class_has", ("pre", "cobol")),
    ("class_has", ("pre", "fortran")),
    ("class_has", ("code", "cobol")),
    ("class_has", ("code", "fortran")),
    ("class_has", ("table", "syntax")),
    ("class_has", ("div", "compiler")),
    ("tag", "article"), ("class", "post"),
    ("class", "entry"), ("class", "content"),
    ("id", "content"), ("tag", "main"),
    ("class", "page"), ("class", "doc"),
    ("class", "blog-post"), ("class", "article"),
    ("class", "entry-content"), ("class", "blog-entry"),
    ("class", "question"), ("class", "answer"),
    ("class", "post-text"), ("class", "comment-body"),
    ("class", "reply"), ("class", "discussion"),
    ("class", "lesson"), ("class", "course"),
    ("class", "curriculum"), ("class", "tutorial"),
    ("class", "lecture"), ("class", "module"),
]

VALUABLE_URL_PATTERNS = [
    "tutorial", "guide", "learn", "how-to", "lesson",
    "example", "documentation", "reference", "course",
    "manual", "handbook", "getting-started", "intro",
    "cheatsheet", "cookbook", "primer", "samples",
    "snippets", "library", "framework", "language",
    "spec", "standard", "book", "ebook", "workshop",
    "specification", "resources", "cheat-sheet",
    "cobol", "fortran", "mainframe", "compiler",
    "interpreter", "coding", "programming", "developer",
]

TECH_KEYWORDS = [
    "programming", "developer", "code", "software", "engineering",
    "tutorial", "api", "language", "compiler", "interpreter",
    "mainframe", "legacy", "vintage", "retro", "historic",
    "cobol", "fortran", "algol", "pascal", "basic",
    "assembler", "assembly", "pl/i", "pl1", "ada", "lisp",
    "prolog", "smalltalk", "jcl", "rpg", "rexx", "natural",
    "ibm", "mvs", "z/os", "os/390", "vm", "vse", "cics",
    "ims", "db2", "vsam", "qsam", "algorithm", "data structure",
]

# Queries with their own vocabulary; a page with three or more of the words
# in its body text is a resource.
LEGACY_VOCABULARY = {
    "cobol": ["cobol", "copybook", "picture", "identification division", "data division",
              "procedure division", "compute", "perform", "display"],
    "fortran": ["fortran", "subroutine", "program", "implicit", "real", "integer",
                "dimension", "format", "common", "equivalence"],
    "pascal": ["pascal", "begin", "end", "procedure", "function", "var", "const", "type",
               "program", "unit"],
    "basic": ["basic", "gosub", "goto", "print", "input", "let", "rem", "dim", "data", "read"],
    "ada": ["ada", "package", "procedure", "function", "begin", "end", "type", "task",
            "protected", "generic"],
}

# ---------------------------------------------------------------------------
# FIXED VALUES (broad extraction)
# ---------------------------------------------------------------------------

LANGUAGES_BROAD = [
    "python", "javascript", "typescript", "java", "kotlin", "c", "c++", "c#",
    "go", "golang", "rust", "swift", "objective-c", "ruby", "php", "scala",
    "perl", "haskell", "clojure", "erlang", "elixir", "dart", "r", "julia",
    "fortran", "assembly", "bash", "shell", "powershell", "matlab", "zig",
    "cobol", "pascal", "ada", "lisp", "prolog", "smalltalk", "basic",
    "algol", "pl/i", "pl1", "jcl", "rpg", "rexx", "natural", "abap",
    "delphi", "vb", "visual basic", "vba", "actionscript", "groovy",
    "html", "css", "sass", "less", "jquery", "react", "vue", "angular",
    "svelte", "ember", "backbone", "next.js", "nuxt.js", "django", "flask",
    "fastapi", "express", "spring", "laravel", "symfony", "rails",
    "android", "ios", "react native", "flutter", "xamarin",
    "sql", "mysql", "postgresql", "mongodb", "sqlite", "redis", "cassandra",
    "dynamodb", "firebase", "supabase", "mariadb", "oracle", "neo4j", "graphql",
    "db2", "vsam", "ims", "adabas", "idms", "datacom",
    "aws", "azure", "gcp", "docker", "kubernetes", "terraform", "serverless",
    "devops", "cicd", "jenkins", "github actions", "gitlab ci",
    "mainframe", "z/os", "os/390", "vm", "vse", "tso", "ispf", "cics",
    "machine learning", "ai", "artificial intelligence", "data science",
    "tensorflow", "pytorch", "keras", "scikit-learn", "pandas", "numpy",
    "algorithm", "data structure", "functional programming", "oop",
    "concurrency", "async", "mvcc", "microservices", "rest api", "websocket",
    "security", "authentication", "encryption", "blockchain", "web3",
    "git", "vscode", "vim", "emacs", "intellij", "eclipse", "atom",
    "testing", "debugging", "performance", "optimization",
]

# Queries moved to the front of the language list.
LEGACY_FIRST_QUERIES = ["cobol", "fortran", "pascal", "basic", "ada", "pl/i", "rpg", "jcl"]

# Queries whose plain <pre> blocks count as snippets when no <pre><code> exists.
LEGACY_PRE_QUERIES = ["cobol", "fortran", "pascal", "basic", "ada"]

CONTENT_SELECTORS_BROAD = [
    "article", ".markdown-body", ".post-content",
    "#content", ".content", "main", ".entry-content",
    ".post", ".resource-content", ".documentation",
    ".tutorial", ".lesson", ".guide",
]

QUALITY_PRIORITY_DOMAINS = [
    "github.com", "stackoverflow.com", "tutorialspoint.com",
    "ibm.com", "w3schools.com", "mozilla.org",
    "docs.oracle.com", "fortran-lang.org", "mainframestechhelp.com",
]

QUERY_PRIORITY_DOMAINS = {
    "cobol": ["ibm.com", "microfocus.com", "tutorialspoint.com/cobol", "mainframestechhelp.com"],
    "fortran": ["fortran-lang.org", "gcc.gnu.org", "netlib.org", "tutorialspoint.com/fortran"],
    "pascal": ["freepascal.org", "delphi.org", "tutorialspoint.com/pascal"],
    "basic": ["visual-basic.com", "vb6.us", "vbtutor.net"],
    "ada": ["adaic.org", "adacore.com", "getadanow.com"],
}

# ---------------------------------------------------------------------------
# FIXED VALUES (narrow rules, distributed crawl)
# ---------------------------------------------------------------------------

RELEVANT_URL_PATTERNS = [
    "tutorial", "guide", "doc", "example", "resource",
    "learn", "library", "framework", "tool", "cheatsheet",
    "python", "javascript", "react", "node", "web", "code",
    "programming", "develop",
]

ALLOWED_DOMAINS: list[str] = []

PROGRAMMING_TITLE_KEYWORDS = ["python", "javascript", "js", "react", "node", "code",
                              "programming", "tutorial", "guide"]

STRUCTURE_SIGNALS_NARROW = [
    ("tag", "pre"), ("tag", "code"),
    ("heading_cs", ("h1", "Guide")),
    ("heading_cs", ("h1", "Tutorial")),
    ("tag", "article"), ("class", "markdown-body"),
    ("class", "documentation"), ("class", "tutorial"),
    ("class", "content-body"), ("class", "post-content"),
]

LANGUAGES_NARROW = ["python", "javascript", "java", "cpp", "c++", "ruby", "php", "golang",
                    "rust", "typescript", "react"]

CONTENT_SELECTORS_NARROW = [
    "article", ".markdown-body", ".post-content",
    "#content", ".content", "main", ".article-content",
    ".documentation", ".tutorial-content",
]

AUTHORITY_URL_PARTS = ["github.com", "stackoverflow.com", "mdn", "w3schools", "reactjs.org"]

# ---------------------------------------------------------------------------
# FIXED VALUES (enrichment)
# ---------------------------------------------------------------------------

LANGUAGE_GROUPS = [
    ("python", ["python", "django", "flask", "numpy", "pandas"]),
    ("javascript", ["javascript", "js", "node", "react", "vue", "angular"]),
    ("java", ["java", "spring", "maven", "gradle"]),
    ("go", ["golang", "go "]),
    ("rust", ["rust", "cargo"]),
    ("php", ["php", "laravel", "symfony"]),
    ("ruby", ["ruby", "rails"]),
    ("c#", ["c#", "csharp", ".net", "dotnet"]),
    ("c++", ["c++", "cpp"]),
]

REPUTATION_SITES = ["github.com", "stackoverflow.com", "docs.python.org"]

# ---------------------------------------------------------------------------
# FIXED VALUES (search)
# ---------------------------------------------------------------------------

FIELD_BOOSTS = {"title": 3.0, "description": 2.0, "content": 1.0,
                "code_snippets": 2.0, "tags": 2.0}
SEARCH_FIELDS = ["title", "description", "content", "code_snippets", "tags"]
HIGHLIGHT_FIELDS = ["title", "description", "content", "code_snippets"]
MAX_PAGE_SIZE = 50
DEFAULT_QUALITY = 0.7
LOW_RESULT_THRESHOLD = 5
SNAPSHOT_LIMIT = 100
TYPE_FACET_SIZE = 10
RESOURCE_TYPES = ["article", "tutorial", "video", "documentation", "repository"]

# Crawl limits.
DEPTH_LIMIT = 12
MAX_PAGES = 10000
BATCH_SIZE = 10
DISTRIBUTE_WINDOW = 101
DEFAULT_QUERY = "python"

LOW_RESULT_MESSAGE = ("Few or no existing results found. "
                      "Started crawling the web for this query.")
ZERO_RESULT_INSTRUCTIONS = ("Please check back later or use the WebSocket mode for live "
                            "updates as we crawl the web for this topic.")
SNAPSHOT_DONE_MESSAGE = "Initial search complete, streaming real-time results"
