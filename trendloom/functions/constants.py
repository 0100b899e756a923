"""Word lists, lookup tables and thresholds."""

# Words and phrases that mark a post as economically relevant.
CONTEXT_TERMS = (
    "market", "trading", "stock", "buy", "sell", "long", "short",
    "bullish", "bearish", "rally", "crash", "earnings", "revenue", "profit",
    "loss", "dividend", "yield", "bond", "treasury", "fed",
    "recession", "gdp", "commodity", "futures", "options", "puts", "calls",
    "breakout", "support", "resistance", "volume", "volatility", "etf",
    "portfolio", "hedge", "risk", "sector", "index", "dow", "nasdaq", "s&p",
    "gold", "silver", "oil", "copper", "wheat", "corn", "lumber",
    "price", "prices", "pricing", "cost", "costs", "expensive", "cheap",
    "afford", "affordability", "msrp", "retail price", "launch price",
    "price increase", "price hike", "price cut", "discount", "sale",
    "inflation", "deflation", "cost of living",
    "supply", "demand", "shortage", "surplus", "allocation", "backlog",
    "sold out", "in stock", "available", "wait list", "backorder",
    "production", "capacity", "inventory", "stockpile",
    "spending", "sales", "consumer", "retail",
    "buying", "purchased", "splurge", "cutting back", "budget",
    "worth it", "value", "deal",
    "hiring", "layoffs", "jobs", "unemployment", "employment",
    "wage", "wages", "salary", "pay", "raise", "pay cut",
    "capex", "margin", "margins", "gross margin", "operating margin",
    "shipments", "deliveries", "orders", "guidance",
    "foundry", "wafer", "chip", "semiconductor", "gpu", "hardware",
    "datacenter", "cloud", "infrastructure",
)

# The noise vocabulary. A deployment may still pass a list of its own, of any length,
# as TermRules(noise_terms=...) or load_terms(spark, path).
# Terms longer than three characters also match inside longer words.
NOISE_TERMS = (
    "federal reserve", "fed", "the fed", "fomc", "powell", "jerome powell", "congress", "senate",
    "house", "white house", "government", "trump", "donald trump", "donald t", "don t", "don trump",
    "donaldtrump", "biden", "joe biden", "harris", "kamala", "obama", "desantis", "musk", "elon",
    "gop", "republican", "republicans", "democrat", "democrats", "democratic", "president",
    "vice president", "treasury", "sec", "ftc", "doj", "cftc", "yellen", "janet yellen", "us",
    "usa", "u.s.", "u.s", "america", "united states", "american", "china", "chinese", "russia",
    "russian", "uk", "eu", "european union", "canada", "canadian", "mexico", "mexican", "japan",
    "japanese", "germany", "german", "france", "french", "india", "indian", "wall street",
    "main street", "stock market", "market", "markets", "stocks", "stock", "shares", "share",
    "equity", "equities", "trade", "trading", "trader", "traders", "investor", "investors",
    "investing", "investment", "portfolio", "position", "positions", "today", "yesterday",
    "tomorrow", "week", "month", "year", "daily", "weekly", "monthly", "yearly", "annual",
    "quarter", "quarterly", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday",
    "sunday", "morning", "afternoon", "evening", "night", "the", "a", "an", "is", "are", "was",
    "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "must", "can", "this", "that", "these", "those", "it", "its",
    "they", "their", "them", "we", "our", "you", "your", "i", "me", "my", "he", "she", "his", "her",
    "who", "what", "when", "where", "why", "how", "which", "all", "each", "every", "both", "new",
    "old", "big", "small", "high", "low", "up", "down", "out", "in", "more", "less", "most",
    "least", "very", "just", "only", "even", "now", "then", "here", "there", "also", "too", "so",
    "yet", "still", "first", "last", "next", "other", "another", "same", "different", "thing",
    "things", "stuff", "something", "anything", "everything", "nothing", "world", "life", "way",
    "ways", "day", "days", "nights", "time", "times", "moment", "moments", "hour", "hours",
    "minute", "minutes", "people", "person", "man", "men", "woman", "women", "guy", "guys", "kid",
    "kids", "group", "groups", "team", "teams", "part", "parts", "side", "sides", "place", "places",
    "area", "areas", "point", "points", "end", "ends", "case", "cases", "fact", "facts", "reason",
    "reasons", "example", "examples", "kind", "kinds", "type", "types", "sort", "sorts", "lot",
    "lots", "step", "steps", "move", "moves", "action", "actions", "change", "changes",
    "experience", "experiences", "story", "stories", "situation", "situations", "problem",
    "problems", "issue", "issues", "question", "questions", "answer", "answers", "idea", "ideas",
    "thought", "thoughts", "opinion", "opinions", "view", "views", "work", "works", "job", "jobs",
    "business", "businesses", "service", "services", "system", "systems", "process", "processes",
    "plan", "plans", "project", "projects", "result", "results", "effect", "effects", "impact",
    "impacts", "outcome", "outcomes", "level", "levels", "rate", "rates", "number", "numbers",
    "amount", "amounts", "worth", "value", "values", "cost", "costs", "money", "cash", "funds",
    "right", "rights", "left", "wrong", "good", "bad", "best", "worst", "better", "worse", "start",
    "beginning", "middle", "top", "bottom", "front", "back", "head", "hand", "hands", "eye", "eyes",
    "face", "body", "mind", "heart", "home", "room", "office", "school", "city", "country", "state",
    "game", "games", "play", "video", "media", "content", "post", "posts", "chat", "message",
    "messages", "call", "calls", "email", "emails", "word", "words", "name", "names", "title",
    "titles", "term", "terms", "don", "dont", "won", "wont", "won t", "cant", "can t", "didnt",
    "didn t", "doesnt", "doesn t", "isnt", "isn t", "arent", "aren t", "wouldn", "wouldn t",
    "couldn", "couldn t", "shouldn", "shouldn t", "hasn", "hasn t", "haven", "haven t", "hadn",
    "hadn t", "gonna", "gotta", "wanna", "kinda", "sorta", "dunno", "idk", "imo", "imho", "lol",
    "lmao", "omg", "wtf", "smh", "tbh", "ngl", "fr", "rn", "af", "donald", "mark", "john", "james",
    "michael", "david", "robert", "william", "richard", "joseph", "thomas", "charles", "chris",
    "daniel", "matt", "matthew", "anthony", "brian", "kevin", "steve", "steven", "paul", "andrew",
    "josh", "mary", "jennifer", "lisa", "sarah", "karen", "nancy", "betty", "susan", "christmas",
    "xmas", "holiday", "holidays", "thanksgiving", "easter", "new year", "new years", "halloween",
    "valentine", "valentines", "birthday", "anniversary", "weekend", "vacation", "rt", "via",
    "breaking", "just in", "news", "update", "thread", "http", "https", "www", "com", "link",
    "click", "follow", "retweet", "like", "comment", "subscribe", "dm", "tweet", "twitter", "cnbc",
    "bloomberg", "reuters", "wsj", "cnn", "fox", "msnbc", "yahoo", "marketwatch", "seeking alpha",
    "zerohedge", "financial times", "wall street journal", "barrons", "investors business daily",
    "inc", "corp", "llc", "ltd", "co", "company", "companies", "corporation", "ceo", "cfo", "coo",
    "executive", "management", "board", "director", "chatgpt", "gpt", "machine learning", "bitcoin",
    "btc", "ethereum", "eth", "crypto", "cryptocurrency", "blockchain", "percent", "percentage",
    "%", "million", "billion", "trillion", "thousand", "hundred", "dollar", "dollars", "usd",
    "price", "prices",
)

# English function words: never a term on their own and never the edge of a phrase.
STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "also", "am", "an", "and",
    "any", "are", "as", "at", "be", "because", "been", "before", "being", "below",
    "between", "both", "but", "by", "can", "could", "did", "do", "does", "doing", "down",
    "during", "each", "even", "every", "few", "for", "from", "had", "has", "have",
    "having", "he", "her", "here", "hers", "him", "his", "how", "i", "if", "in", "into",
    "is", "it", "its", "just", "may", "me", "might", "more", "most", "must", "my", "no",
    "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "out",
    "over", "own", "same", "she", "should", "so", "some", "still", "such", "than", "that",
    "the", "their", "them", "then", "there", "these", "they", "this", "those", "through",
    "to", "too", "under", "until", "up", "very", "was", "we", "were", "what", "when",
    "where", "which", "while", "who", "whom", "why", "will", "with", "would", "yet",
    "you", "your",
)

# Keyword -> symbol per family, in lookup order.
COMMODITY_SYMBOLS = (
    ("gold", "GC=F"), ("silver", "SI=F"), ("platinum", "PL=F"), ("palladium", "PA=F"),
    ("oil", "CL=F"), ("crude", "CL=F"), ("crude oil", "CL=F"), ("wti", "CL=F"),
    ("brent", "BZ=F"), ("natural gas", "NG=F"), ("nat gas", "NG=F"), ("natgas", "NG=F"),
    ("copper", "HG=F"), ("wheat", "ZW=F"), ("corn", "ZC=F"), ("soybeans", "ZS=F"),
    ("soybean", "ZS=F"), ("coffee", "KC=F"), ("sugar", "SB=F"), ("cocoa", "CC=F"),
    ("cotton", "CT=F"), ("lumber", "LBS=F"), ("uranium", "URA"),
)
CRYPTO_SYMBOLS = (
    ("bitcoin", "BTC-USD"), ("btc", "BTC-USD"), ("ethereum", "ETH-USD"), ("eth", "ETH-USD"),
    ("solana", "SOL-USD"), ("sol", "SOL-USD"), ("xrp", "XRP-USD"), ("ripple", "XRP-USD"),
    ("cardano", "ADA-USD"), ("ada", "ADA-USD"), ("dogecoin", "DOGE-USD"), ("doge", "DOGE-USD"),
    ("litecoin", "LTC-USD"), ("ltc", "LTC-USD"),
)
INDEX_SYMBOLS = (
    ("s&p", "^GSPC"), ("s&p 500", "^GSPC"), ("sp500", "^GSPC"), ("spx", "^GSPC"),
    ("spy", "SPY"), ("nasdaq", "^IXIC"), ("qqq", "QQQ"), ("dow", "^DJI"), ("djia", "^DJI"),
    ("dow jones", "^DJI"), ("russell", "^RUT"), ("russell 2000", "^RUT"), ("iwm", "IWM"),
    ("vix", "^VIX"), ("volatility", "^VIX"),
)
SECTOR_SYMBOLS = (
    ("energy", "XLE"), ("financials", "XLF"), ("technology", "XLK"), ("tech", "XLK"),
    ("healthcare", "XLV"), ("consumer discretionary", "XLY"), ("consumer staples", "XLP"),
    ("industrials", "XLI"), ("materials", "XLB"), ("utilities", "XLU"),
    ("real estate", "XLRE"), ("communication", "XLC"),
)

# Symbols always quoted for context, and terms used on a quiet day.
COMMON_SYMBOLS = ("GC=F", "SI=F", "CL=F", "SPY", "^VIX", "BTC-USD")
FALLBACK_TERMS = ("Federal Reserve", "Stock Market", "Inflation")

# Keywords that decide the category of a plain-word trend.
COMMODITY_KEYWORDS = ("gold", "silver", "oil", "copper", "wheat", "corn", "uranium", "lithium")
SECTOR_KEYWORDS = ("tech", "biotech", "pharma", "energy", "solar", "ev", "semiconductor", "defense")

# Topics watched by default; alternatives are separated by " OR ".
DEFAULT_TOPICS = (
    "shortage OR sold out",
    "supply OR allocation",
    "hiring OR layoffs",
    "tariff OR tariffs",
    "price increase OR price hike",
    "bullish OR bearish",
    "semiconductor OR chip shortage",
    "shipping delays OR freight",
)
