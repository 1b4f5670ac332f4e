"""The rules, phrases and constants that decide results.

Everything in this file is data. The patterns and word lists are stated as they
must be for the labels and masks to come out right; operators take them as
default arguments, so a user can pass others.
"""

# Mask tokens.
MASK_TOKENS = [
    "[TITLE]", "[CONTENT]",
    "[ROLE]", "[SALARY]", "[YEARS]", "[LEETCODE]", "[INDUSTRY]",
    "[MANAGER]", "[ICLEVEL]", "[URL]", "[ORG]", "[GPE]", "[INFO]", "[SKILL]",
]

# The word that makes a comment a candidate for an offer.
OFFER_CANDIDATE = r"\bdm\b"

# Offer rules as (label, pattern), in order of application.
OFFER_INCLUDE = [
    ("dm*", r"^\s*dm\s*$"),
    ("*dm.!", r"\bdm\b\s*[.!]?$"),
    ("*dm,.!-*", r"\bdm\b\s*[-,.!]+\s+"),
    ("dm?", r"^\s*\bdm\b\?\s*$"),
    ("dm :)", r"\bdm\b\s*[:;]-?[)D]"),
    ("dm bro", r"\s*dm\s+bro(?:[\s\W]|$)"),
    ("dm pls", r"\s*dm\s+pls(?:[\s\W]|$)"),
    ("dm resume", r"\s*dm\s+resume(?:[\s\W]|$)"),
    ("dm cv", r"\s*dm\s+cv(?:[\s\W]|$)"),
    ("dm job", r"\s*dm\s+job(?:[\s\W]|$)"),
    ("dm role", r"\s*dm\s+role(?:[\s\W]|$)"),
    ("dm job link", r"\s*dm\s+job\s+link(?:[\s\W]|$)"),
    ("dm me", r"\s*dm\s+me(?:[\s\W]|$)"),
    ("dm ne", r"\s*dm\s+ne(?:[\s\W]|$)"),
    ("dm and", r"\bdm\s+and\b\s+"),
    ("dm here", r"\bdm\s+here\b\s*"),
    ("dm if", r"\bdm\s+if\b\s+"),
    ("dm - if", r"\bdm\s+-\s+if\b\s+"),
    ("dm only if", r"\bdm\s+only\s+if\b\s+"),
    ("dm and share", r"\bdm\s+and\s+share\b\s+"),
    ("dm with", r"\bdm\s+with\s+\b"),
    ("dm your", r"\bdm\s+your\s+\b"),
    ("dm so that i", r"\bdm\s+so\s+that\s+i\b"),
    ("dm for [char]", r"\bdm\s+for\s+.+"),
    ("dm in for [company]", r"\bdm\s+in\s+for\s+\w+\b"),
    ("dm for [company]", r"\bdm\s+for\s+\w+\b"),
    ("dm fo [company]", r"\bdm\s+fo\s+\w+\b"),
    ("dm or [company]", r"\bdm\s+or\s+\w+\b"),
    ("dm 4 [company]", r"\bdm\s+4\s+\w+\b"),
    ("dm me for [company]", r"\bdm\s+me\s+for\s+\w+\b"),
    ("dm me or [company]", r"\bdm\s+me\s+or\s+\w+\b"),
    ("dm me 4 [company]", r"\bdm\s+me\s+4\s+\w+\b"),
    ("dm adobe", r"\bdm\s+adobe\b"),
    ("dm canva", r"\bdm\s+canva\b"),
    ("feel free to dm", r"\bfeel\s+free\s+to\s+dm\b"),
    ("send dm", r"^send\s+dm\b"),
    ("send me dm", r"^send\s+me\s+dm\b"),
    ("send me a dm", r"^send\s+me\s+a\s+dm\b"),
    ("shoot me dm", r"^shoot\s+me\s+dm\b"),
    ("shoot me a dm", r"^shoot\s+me\s+a\s+dm\b"),
    ("you can dm", r"^you\s+can\s+dm\b"),
    ("please dm *", r"^please\s+dm\s*"),
    ("pls dm *", r"^pls\s+dm\s*"),
    ("* please dm", r"\bplease\s+dm\b$"),
    ("dm please", r"^dm\s+please\s*"),
    ("happy to refer", r"\bhappy\s+to\s+refer\b\s*"),
    ("happy to help", r"\bhappy\s+to\s+help\b\s*"),
    ("I would refer", r"\bi\s+would\s+refer\b\s*"),
    ("I could refer", r"\bi\s+would\s+refer\b\s*"),
    ("I can refer", r"\bi\s+can\s+refer\b\s*"),
    ("I can help", r"\bi\s+can\s+help\b\s*"),
    ("I will refer", r"\bi\s+will\s+refer\b\s*"),
    ("Ill refer", r"\bill\s+refer\b\s*"),
    ("sure dm", r"\bsure[\s,.!?]*dm\b"),
    ("SAP referral", r"\bDM and anyone else for a referral\b"),
    ("DM (anyone else can also dm)", r"DM\s*\(\s*anyone\s*else\s*can\s*also\s*dm\s*\)"),
    ("DM (open for all)", r"DM\s*\(\s*open\s*for\s*all\s*\)"),
]
OFFER_EXCLUDE = [
    ("may I dm", r"\bmay\s+i\s+dm\b"),
    ("I can dm", r"\bi\s+can\s+dm\b"),
    ("can I dm", r"\bcan\s+i\s+dm\b"),
    ("can I ask", r"\bcan\s+i\s+ask\b"),
    ("can I please dm", r"\bcan\s+i\s+please\s+dm\b"),
    ("can I pls dm", r"\bcan\s+i\s+pls\s+dm\b"),
    ("could I please dm", r"\bcould\s+i\s+please\s+dm\b"),
    ("can you please dm", r"\bcan\s+you\s+please\s+dm\b"),
    ("sent dm", r"\bsent\s+dm\b"),
    ("dm you", r"\bdm\s+you\b"),
    ("how to dm", r"\bhow\s+to\s+dm\b"),
    ("how do we dm", r"\bhow\s+do\s+we\s+dm\b"),
    ("can not dm", r"\bcan\s+not\s+dm\b"),
    ("mind if I dm", r"\bmind\s+if\s+i\s+dm\b"),
    ("dm-d", r"\s*\bdm'd\b\s*"),
    ("dm--d", r"\s*\bdm’d\b\s*"),
    ("dm-ed", r"\s*\bdm'ed\b\s*"),
    ("dm--ed", r"\s*\bdm’ed\b\s*"),
    ("dm ed", r"\s*\bdm\s+ed\b\s*"),
    ("I am interested", r"\bi\s+am\s+interested\b"),
]

# Broad mention of a referral.
REFERRAL_MENTION = (
    r"\b(referral|referrals|refer|dm me|help|seeking|looking for|need|request)\b|#referral|#needajob"
)

# Phrases of an explicit request, each matched as whole words.
REQUEST_PHRASES = """
need a
looking for a
seeking a
requesting a
need
needed
looking for
seeking
requesting
request
requested
can anyone
can someone
could anyone
could someone
would anyone
is anyone able to
can anyone help
can anyone help me
can anyone help me out
could anyone help
could someone help
could anyone assist
would anyone be able to
can i get
can you provide me
refer me
recommend me
connect me
connect me for
refer me to
help with a referral
help me get
help me out
set me up with
set me up with a referral
hook me up with
hook me up with a
willing to submit me
willing to give a referral
willing to refer
kindly help me to get
submit me for a referral
would really appreciate a referral
appreciate any referrals
appreciate a referral
anyone here willing to submit
anyone have connections at
anyone with connections at
does anyone know
does anyone work for
anyone know someone at
anyone familiar with
anyone able to assist
anyone who could help
anyone able to help
anyone able to provide
anyone open to
anyone available for
anyone open to a referral
anyone available for a referral
is someone willing
anyone willing to give
anyone willing to give out
anyone able to give
anyone able to give out
if anyone would be willing
would appreciate
would greatly appreciate
would be greatly appreciated
would love
any chance of
is there anyone
i need
i am interested in
please dm
please refer
please connect
please help
please assist
please recommend
help me with
need assistance
can i please
referral please
""".strip().split("\n")

# Platform cues as (feature, pattern).
PLATFORM_CUES = [
    ("layoff", r"\b(layoff(s)?|(laid|lay|laying)(\s+(me|us)\s+)?off|let(\s+(me|us)\s+)?go|(terminate|eliminate)(d)?(\s+(me|us)\s+)?)\b"),
    ("pip", r"\b(pip|pipped|piped|pipd|pip'd|pre-pip|pre pip|rif|riffed|rifed|pre-rif|pre rif|rif/pip|pip/rif|in focus)\b"),
    ("company_name", r"\[ORG\]"),
    ("job_title", r"\[ROLE\]"),
    ("year_of_experience", r"\[YEARS\]"),
    ("total_compensation", r"\[SALARY\]"),
    ("reason_for_seeking_career", r"\b(?:seeking\s+new\s+opportunities|looking\s+for\s+growth|career\s+transition|transitioning\s+to|seeking\s+better\s+work-life\s+balance|laid\s+off)\b"),
    ("previous_experience", r"\b(designed|built|developed|automated|implemented|created|optimized|worked on|participated in|led|contributed to|teams at companies like|in projects for|for clients like|impactful projects|significant projects|AWS SDE[1-3]|over \d+\s+years? of experience\s+across\s+[a-zA-Z\s,]+|experience in\s+[a-zA-Z\s,]+)\b"),
    ("skillset", r"\b(python|java|sql|excel|machine learning|project management|data analysis|cloud computing|HFSS|Matlab|MATLAB|ANSYS|Simulink|CAD|R|azure|pyspark|etl processes|dashboards|data solutions)\b"),
    ("student_status", r"\b(student|undergrad|graduate|master's|PhD|internship|will be a (college|university) graduate|graduating in \w+ \d{4}|I'm graduating in \w+|new grad|recent graduate)\b"),
]

# A position held somewhere also counts as previous experience.
# The first pattern is a cheap necessary condition of the second.
POSITION_HINT = r"(consultant|analyst|associate|specialist|engineer|manager|director)\s+at\s"
POSITION_HELD = r"\b[a-zA-Z\s]+(consultant|analyst|associate|specialist|engineer|manager|director)\s+at\s+[a-zA-Z\s]+\b"

# In compatible mode the four token cues are character classes;
# the last one is matched with case.
CLASS_CUES = {
    "company_name": "(?i)[ORG]",
    "job_title": "(?i)[ROLE]",
    "year_of_experience": "(?i)[YEARS]",
    "total_compensation": "[SALARY]",
}

# Cues from the literature as (feature, pattern).
LITERATURE_CUES = [
    ("urgency", r"\burgently\b|\basap\b|\btime[-\s]?sensitive\b|\bimmediately\b|\bimpress\b|\bpressing\b|\bdeadline\b|\bnow\b|\bquickly\b|\bspeedily\b|\brush\s+off\b|\bcrucial\b|\bimportant\b|\bwithin\s+the\s+next\b"),
    ("gratitude", r"\bthank\b|\bthanks\b|\bappreciate\b|\bgrateful\b|\bmuch\s+appreciated\b|\bthankful\b|\bgreatly\s+appreciated\b"),
    ("politeness", r"\bplease\b|\bmay\s?I\b|\bcould\s?you\b|\bkindly\b|\bexcuse\s?me\b|\bif\s?you\s?please\b|\bI\s+would\s?appreciate\b"),
    ("familiarity", r"\b(?:Hey|Hi\s+everyone|Anyone\s+know|Can\s+anyone\s+help|Hey\s+guys|Hello\s+there)\b"),
    ("being_desperate", r"\bplease\b|\bgot\s+stuck\b|\bdesperate\b|\bstruggling\b|\bhelp\s+me\b|\bneed\s+advice\b|\blost\b|\bcan't\s+find\b|\bany\s+help\s+would\s+be\s+great\b"),
    ("inclusive_exclusive", r"\b(?:we|I|they|us|our|their)\b"),
    ("being_content", r"\bhappy\s+with\b|\bsatisfied\s+with\b|\blove\s+my\s+job\b|\benjoy\s+working\b"),
    ("interview_readiness", r"\bleetcode\b|\binterview\s?questions\b|\bpreparation\b|\bmock\s?interview\b|\btechnical\s+interview\b"),
    ("evidentiality", r"\b(?:have\s+strong\s+background|have\s+experience|am\s+skilled\s+in|bring\s+years\s+of|worked\s+on|familiar\s+with)\b"),
    ("reciprocity", r"\bhappy\s+to\s+help\b|\boffer\s+help\s+in\s+return\b|\bassist\s+you\s+in\s+the\s+future\b|\bhelp\s+others\s+in\s+return\b"),
    ("high_status", r"\b(?:been\s+in\s+the\s+industry\s+for\s+\d+\s+years|received\s+awards|promoted\s+to|led\s+teams|recognized\s+as\s+an\s+expert)\b"),
    ("gain_loss_framing", r"\b(?:mean\s+a\s+lot|gain\s+so\s+much|change\s+my\s+life|impact\s+me|losing\s+hope)\b"),
]

# Jargon left out of the count of unknown words.
JARGON = [
    "iclevel", "leetcode", "url", "org", "gpe", "yrs", "tc", "dm", "pip", "pm", "swe", "ds", "sde", "de", "us", "eu",
    "rif", "aws", "gcp",
]

# Firm names added to those found in the data, and names that
# are also common words.
EXTRA_FIRMS = [
    'xoogle', 'xoogler', 'aws', 'zillow', 'cedar', 'incomm', 'incomm payments', 'jane street', 'visa', 'ms', 'msft',
    'goog', 'jpmc', 'anthropic', 'disney', 'figma', 'snap chat', 'snapchat', 'duo lingo', 'duolingo', 'mindtickle',
    'slalom', 'esri', 'reality labs', 'caret', 'c^ret', 'pseg', 'cvs', 'twitter', 'twitterx', 'twitter/x',
    'twitter / x', 'citrix', 'cloud fare', 'citi bank', 'oci', 'swiggy', 'playstation', 'vast', 'andurilindustries',
    'relativity space', 'zip recruiter', 'expedia', 'scale ai', 'square', 'chase', 'jp', 'jpm', 'johnson', 'tia',
    'venmo', 'azure', 'gcp', 'slack', 'nvidia', 'nvdia', 'morgan', 'amzn', 'meraki', 'fidelity', 'visa referral',
    'ixl', 'dbt', 'oracle cloud', 'open ai', 'openai', 'delta airlines', 'delta', 'united airlines', 'american air',
    'american airlines', 'aa', 'citi', 'vantara', 'sanofi', 'booz allen', 'lockheed martin', 'samara', 'monzo',
    'door dash', 'amazonian', 'amazonians', 'garena', 'okx', 'oraclecloud', 'akamai', 'alibaba', 'alation',
    'amakunacapital', 'appdynamics', 'baidu', 'barclays', 'blizzard', 'booking', 'cameo', 'codenation', 'deshaw',
    'didi', 'dunzo', 'epic', 'evernote', 'hrt', 'hulu', 'janestreet', 'jpmorgan', 'patreon', 'pocketgems', 'ponyai',
    'poshmark', 'postmates', 'quip', 'sapient', 'splice', 'triplebyte', 'yandynga', 'zappos', 'zulily', 'facebook',
    'brgoogle', 'cashapp', 'cash app', 'mongodb', 'symbotic', 'youtube', 'discover', 'rtx', 'pnw', 'zapier',
    'millenium', 'millennium', 'wework', 'amramp', 'cockroachlabs', 'pluto', 'adobe', 'surescripts', 'dentsu',
    'tik tok', 'hims & hers health', 'fiserve', 'mollie', 'catawiki', 'kainos', 'linked in', 'redbull', 'red bull',
    'aha!', 'renesas', 'proctor and gamble', 'proctor & gamble', 'P&G', 'P & G', 'PG&E', 'PG & E', 'whatsapp',
    'Merkle', 'Veradigm', 'Captech', 'Bose', 'Hubell', 'Pinnaclegroup', 'Pinnaclegroupinc', 'Donux', 'Koent', 'Kong',
    'Mightyhive',
]
FIRM_EXCEPTIONS = [
    "new", "here", "january", "visa", "match", "tableu", "tableau", "outreach", "chief", "mongodb",
]

# Place names added to a gazetteer, and words never masked as places.
EXTRA_PLACES = [
    'canada', 'india', 'finland', 'england', 'europe', 'ireland', 'scotland', 'switzerland', 'germany', 'france',
    'italy', 'spain', 'china', 'japan', 'korea', 'south korea', 'north korea', 'russia', 'australia', 'new zealand',
    'mexico', 'brazil', 'argentina', 'egypt', 'nigeria', 'south africa', 'turkey', 'saudi arabia', 'qatar',
    'singapore', 'malaysia', 'thailand', 'indonesia', 'philippines', 'vietnam', 'london', 'paris', 'tokyo',
    'new york', 'los angeles', 'chicago', 'beijing', 'shanghai', 'hong kong', 'dubai', 'mumbai', 'delhi',
    'bangalore', 'sydney', 'melbourne', 'united states', 'great britain', 'united kingdom', 'barcelona',
    'remote europe', 'remote us', 'west coast', 'east coast', 'eastern europe', 'western europe', 'bay area',
    'midwest', 'mid west', 'south', 'seattle', 'mission bay', 'manhattan', 'brooklyn', 'bayarea',
]
STATE_CODES = [
    "al", "ak", "az", "ar", "ca", "co", "ct", "de", "fl", "ga", "hi", "id", "il", "in", "ia", "ks", "ky", "la", "me",
    "md", "ma", "mi", "mn", "ms", "mo", "mt", "ne", "nv", "nh", "nj", "nm", "ny", "nc", "nd", "oh", "ok", "or", "pa",
    "ri", "sc", "sd", "tn", "tx", "ut", "vt", "va", "wa", "wv", "wi", "wy",
]
PLACE_CODES = [
    'eu', 'usa', 'uk', 'uae', 'nyc', 'sf', '/us', '-us', 'the us', 'in us', 'u.s', 'u.s.', 'the u.s.', 'the u.s',
    'across us', 'sfo', 'lax', 'lga', 'sea', '(us)', 'oc', 'us/', 'us based', 'outside us', '/can', 'can.',
]
PLACE_EXCEPTIONS = [
    'bar', 'hook', 'hit', 'in', 'id', 'or', 'hi', 'me', 'can', 'hm', 'of', 'along', 'officer', 'python', 'nice',
    'most', 'university', 'same', 'opportunity', 'than', 'come', 'god', 'much', 'management', 'refer', 'swe', 'ds',
    'normal', 'pace', 'tc', 'nightfall', 'persona', 'minware', 'Ad Tech', 'columbia', 'january', 'february', 'march',
    'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december', 'deal', 'cv',
    'enterprise', 'advance', 'finance', 'mentor', 'best', 'co', 'goes', 'de', 'date', 'node', 'sake', 'pop', 'save',
    'buy', 'berkeley', 'peer', 'lend', 'golden', 'mission', 'surprise',
]

# Stems and endings of job titles.
MANAGER_STEMS = ['product', 'program', 'project', 'account', 'sales', 'sale', 'customer']
MANAGER_CODES = ['PM', 'TPM', 'PGM', 'PJM', 'PMT', 'PMS', 'UX', 'UXD']
MANAGER_ENDINGS = ['manager', 'management', 'designer', 'design']
MANAGER_LEADS = ['technical', 'tech']
ENGINEER_STEMS = [
    'backend', 'frontend', 'python', 'software', 'software development', 'software developer', 'software dev',
    'software engineering', 'softwareengineering', 'software engineer', 'software eng', 'machine learning',
    'artificial intelligence', 'full stack', 'full-stack', 'business', 'business intelligence', 'business intel',
    'biz', 'biz intelligence', 'biz intel', 'research', 'data', 'engineer', 'engineering', 'solutions', 'developer',
    'techical support', 'support', 'mechanical', 'mechanic', 'thermal', 'mechanics', 'document', 'cloud', 'testing',
    'software testing', 'quality', 'quality assurance', 'mlops', 'ml ops', 'analytics',
    'SWE', 'SDE', 'DE', 'ML', 'MLE', 'AI', 'ML/AI', 'AI/ML', 'BI', 'BIE', 'STE', 'SDET', 'QA',
]
ENGINEER_ENDINGS = ['eng', 'engineer', 'engineering', 'dev', 'development', 'developer', 'devops', 'role', 'roles']
ENGINEER_NOT_ALONE = [
    'ML', 'AI', 'ML/AI', 'AI/ML', 'support', 'document', 'business', 'research', 'data', 'solutions', 'cloud',
    'testing', 'quality', 'python',
]
GRADED_CODES = ['sde', 'swe']
SCIENCE_STEMS = [
    'applied', 'research', 'research data', 'algorithm', 'algorithms', 'algorithms data', 'data', 'business',
    'scientist', 'science', 'software', 'marketing', 'marketing data', 'product marketing', 'product marketing data',
    'DS', 'DE', 'DA', 'RS', 'AI', 'ML', 'AI/ML', 'ML/AI',
]
SCIENCE_ENDINGS = ['science', 'scientist', 'research', 'researcher']
ANALYST_STEMS = [
    'data', 'business data', 'biz data', 'research', 'research data', 'HR', 'Human Resource', 'Human Resources',
    'marketing',
]
ANALYST_ENDINGS = ['analyst', 'analytics', 'analysis']
OTHER_ROLES = ['market analyst', 'consultant', 'trader', 'HR', 'recruiter', 'recruitment']

# Pay terms and amounts.
PAY_LEADS = ['total', 'current', 'previous', 'curr', 'prev', 'tot', 'was']
PAY_TERMS = ['compensation', 'comp', 'pay', 'salary', 'package', 'TC']
PAY_AMOUNT = r"((?:\$|dollars?|£|pounds?|€|euros?|₹|rupees?)?\d+\+?[kKmM]?\+?)"

# Experience and coding-score terms.
EXPERIENCE_TERMS = ['yrs of experience', 'years of experience', 'yrs of', 'years of', 'yoe', 'years', 'yrs', 'year']
SCORE_TERMS = ['leetcode', 'lc']

# Job levels and the three ways a level number is written.
MANAGER_LEVELS = ['Senior Manager', 'Manager', 'EM', 'PEM', 'SDM', 'MGR', 'EDM']
SENIORITIES = ['Entry', 'Junior', 'Senior', 'Staff', 'Senior/Staff', 'Principal', 'JR', 'SR']
LEVEL_NAMES = [
    r'Level\s?', r'Senior/Staff\s?', r'Grade\s?', r'Band\s?', 'new grad', 'post grad', 'tech lead', 'new-grad',
    'tech-lead', 'intern', 'interns', 'internship', 'internships', 'undergrad', 'undergrads', 'grads', 'grad',
    'undergraduates', 'graduates', 'undergraduate', 'ICT', 'ICL', 'IC', 'E', 'L', 'I', 'T',
]
LEVEL_NUMBERS = [r'\s*\d+\.\d', r'\s*\d+', r'\s*(?:i|ii|iii|iv|v|vi|vii|viii)']
LEVEL_LEADS = r'(?:junior|senior|staff|jr|sr)'
BARE_SENIORITY = r'\b(mid|junior|senior|staff|principal|jr|sr)\b'

# Industries.
INDUSTRIES = [
    'supply chain', 'big tech', 'management consulting', 'motor sport', 'finance tech', 'social media',
    'social networking', 'mechanical engineering', 'tech', 'finance', 'consulting', 'healthcare', 'retail', 'media',
    'transportation', 'logistics', 'rideshare', 'saas', 'ecommerce', 'security', 'cybersecurity', 'crypto',
    'motorsport', 'fintech', 'marketplace', 'ads', 'advertisement', 'manufacturing', 'manufacture', 'sustainability',
]

# Names never taken for organisations by a model, and
# abbreviations written in capitals.
ORG_EXCEPTIONS = [
    "partner", "product", "sde", "tc", "yoe", "swe", "pm", "phd", "kindest", "’m", "lookout", "wedding",
] + [f'{i}k' for i in range(10)]
CAPITAL_TERMS = ['i', 'tc', 'yoe', 'col']

# Stop-words that carry meaning here and are kept.
KEPT_STOPWORDS = [
    "rather", "nothing", "anyone", "first", "mostly", "please", "during", "someone", "serious", "whoever", "only",
    "because", "except", "anything", "again", "since", "something", "whenever", "everyone", "nobody", "across",
    "upon", "within", "while", "really", "several", "give", "get", "many", "whatever", "where", "down", "perhaps",
    "anywhere", "toward", "became", "somewhere", "somehow", "nowhere", "should", "wherever", "everywhere",
    "elsewhere", "seemed", "even", "everything", "least", "towards", "use", "full", "about", "enough", "sometime",
    "after", "made", "along", "haven't", "throughout", "might", "how", "never", "although", "beforehand", "become",
    "anyway", "off",
]

# Display caps of the engagement counts.
DISPLAY_CAPS = {"num_views": 500, "num_likes": 6, "num_comments": 20}

# A firm with fewer train rows is pooled under this name.
SMALL_FIRM_ROWS = 10
SMALL_FIRM = "SMALL_FIRM"

# Inverse penalty per feature set, and the searched grid.
TUNED_C = {
    "domain_full": 0.2766631643320149,
    "ngram": 1.0115482193209608,
    "bert_sent_base": 0.7360098119089060,
    "bert_sent_soft": 0.9632521270671345,
    "bert_sent_hard": 1.0115482193209608,
    "bertmix_sent_base": 0.5763025457164991,
    "bertmix_sent_soft": 0.6674064164258308,
    "bertmix_sent_hard": 0.7008692253340656,
}
C_GRID = (0.0001, 20.0, 500)
