"""Word lists and phrases that the operators' definitions name."""

FUNCTION_WORDS = (
    "the a an this that these those some any no every each either neither both all many much few several most more less "
    "little other another such what which whose whichever whatever of in to for with on at from by about as into through "
    "during before after above below between under over against among within without toward upon per via despite across "
    "behind along and or but nor so yet while whereas although though because since unless if when where than whether "
    "until i me my mine myself you your yours yourself he him his himself she her hers herself it its itself we us our "
    "ours ourselves they them their theirs themselves one ones who whom there am is are was were be been being have has "
    "had having do does did doing will would shall should can could may might must need dare ought not very too also just "
    "only even still already ever never here how why"
).split()
PRONOUNS = {
    "first_singular": "i me my mine myself".split(),
    "second_person": "you your yours yourself yourselves".split(),
    "third_person": "he she it him her his hers its they them their theirs himself herself itself themselves".split(),
    "first_plural": "we us our ours ourselves".split(),
}
TRANSITIONS = ("however", "therefore", "moreover", "furthermore", "nevertheless", "thus", "consequently", "in addition", "for example", "for instance", "on the other hand", "in contrast", "similarly", "meanwhile", "finally")
HEDGES = "maybe perhaps possibly seems appears tends likely roughly approximately somewhat quite rather".split()
BOOSTERS = "certainly clearly obviously definitely undoubtedly absolutely indeed always never must".split()
BE_FORMS = "am is are was were be been being".split()
FORMAL = "therefore consequently furthermore nevertheless however thus accordingly moreover hence whereas regarding concerning indeed nonetheless subsequently".split()
CASUAL = ("yeah", "gonna", "wanna", "kinda", "sorta", "gotta", "dunno", "lemme", "ain't", "y'know", "stuff", "thingy", "cool", "awesome", "anyway")
PUNCTUATION = ".,;:!?\"'()—–-/"
NEGATIONS = ("not", "no", "never", "none", "neither", "cannot", "isn't", "aren't", "wasn't", "weren't", "doesn't", "don't", "didn't")
MODALS = ("may", "might", "could", "perhaps", "possibly", "likely", "appears", "suggests")
UNIT_STOPWORDS = "the a an and or of to in on is are was were be by for with as at not no it we they he she if so but do does did".split()
STOCK_PHRASES = (
    "it is important to note", "it is essential to", "it is crucial to", "it is worth noting", "however, it is", "in conclusion", "in summary",
    "first and foremost", "lastly", "furthermore", "needless to say", "as previously mentioned", "as mentioned earlier", "all in all",
    "when it comes to", "it goes without saying", "in the realm of", "in today's", "on the one hand", "on the other hand", "it is noteworthy",
    "it should be noted", "it bears mentioning", "it is evident", "as a result", "consequently", "as can be seen", "it is clear that", "it is apparent",
)
#: rule_id, source, target, sense, confidence
RULES = (
    ("cr-001", "utilize", "use", "general", 0.95), ("cr-002", "commence", "begin", "general", 0.9), ("cr-003", "terminate", "end", "general", 0.9),
    ("cr-004", "assist", "help", "general", 0.9), ("cr-005", "demonstrate", "show", "general", 0.85), ("cr-006", "purchase", "buy", "business", 0.85),
    ("cr-007", "subsequent", "later", "formal", 0.8), ("cr-008", "approximately", "about", "general", 0.9), ("cr-009", "numerous", "many", "formal", 0.85),
    ("cr-010", "sufficient", "enough", "general", 0.9), ("cr-011", "facilitate", "help", "general", 0.8), ("cr-012", "obtain", "get", "general", 0.9),
    ("cr-013", "consequently", "so", "formal", 0.75), ("cr-014", "additionally", "also", "formal", 0.8), ("cr-015", "endeavor", "try", "formal", 0.85),
    ("cr-016", "ascertain", "determine", "formal", 0.8), ("cr-017", "initial", "first", "formal", 0.85), ("cr-018", "frequently", "often", "general", 0.9),
    ("cr-019", "regarding", "about", "formal", 0.85), ("cr-020", "administer", "give", "medical", 0.75), ("cr-021", "reside", "live", "legal", 0.75),
    ("cr-022", "comply", "follow", "legal", 0.8), ("cr-023", "physician", "doctor", "medical", 0.8), ("cr-024", "medication", "medicine", "medical", 0.7),
)
FORBIDDEN_BIGRAMS = ("a a", "of of", "the the", "to to", "use use")
