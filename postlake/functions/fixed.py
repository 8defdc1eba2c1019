"""Fixed values of the posting classifiers: word lists, patterns, labels and points. No logic here."""

# Program rules in their order, as (label, pattern, whether it stands between word edges).
INTERNSHIPS = [
    ("intern", r"intern(?:s|ships?)?", True),
    ("externship", r"extern(?:s|ships?)?", True),
    ("working student", r"working student", True),
    ("student worker", r"(?:student worker|student researcher)", True),
    ("student trainee", r"(?:(?:student|industrial|summer|vacation) trainee|traineeship)", True),
    ("summer student", r"(?:summer student|vacation employment)", True),
    ("placement", r"(?:industrial placement|placement student|student placement|placement year|sandwich placement|year in industry|industrial attachment)", True),
    ("work placement", r"(?:work experience placement|work[- ]integrated learning|professional experience year|industry[- ]based learning|student work placement(?: program)?)", True),
    ("summer analyst", r"summer (?:analyst|associate)", True),
    ("vacation program", r"(?:vacation scheme|vacationer(?: program)?|summer clerk|vacation clerk)", True),
    ("cadetship", r"cadetship", True),
    ("articleship", r"articleship", True),
    ("werkstudent", r"werkstudent(?:in)?", True),
    ("praktikum", r"(?:praktik(?:um|ant(?:in)?)?|praktyk(?:ant|i))", True),
    ("stagiaire", r"(?:stagiaire|alternan(?:t|ce)|cesure)", True),
    ("stagiair", r"(?:stagiair|stagiu|stagiar)", True),
    ("stage (FR/NL)", r"^(?!(?:stage\s*[-:]?\s*)(?:manager|hand|crew|technician|tech|carpenter|operations|production|lighting|audio|director|supervisor|lead|setup|labor|rigging)(?:$|[^\p{L}\p{N}]))(?:stage\s*[-:]?\s*\p{L}|(?:afstudeer|meewerk)stage)", False),
    ("stage delimited (FR/IT)", r"^(?!.*\b(?:early|growth|late|seed|clinical|development|life)\s*(?:-\s*)?stage\b).*(?:\s[-|/(]\s*)stage(?=$|[^\p{L}\p{N}])", False),
    ("estagio", r"estagi(?:o|ari[oa])", True),
    ("practicante", r"(?:practicas|practicante|pasantia|pasante|becari[oa])", True),
    ("tirocinio", r"(?:tirocinio|tirocinante|stagista)", True),
    ("staz", r"staz(?:ysta|ystka|ista)?", True),
    ("harjoittelija", r"(?:harjoittelu|harjoittelija)", True),
    ("stajyer", r"stajyer", True),
    ("gyakornok", r"gyakornok", True),
    ("стажер", r"стажер", False),
    ("стажировка", r"стажировк", False),
    ("praksa", r"praksa", True),
    ("πρακτικη ασκηση", r"πρακτικη ασκηση", False),
    ("magang", r"magang", True),
    ("thuc tap sinh", r"thuc tap sinh", True),
    ("ฝึกงาน", r"(?:ฝึกงาน|ฝกงาน)", False),
    ("インターン", r"インターン", False),
    ("인턴", r"인턴", False),
    ("实习", r"(?:实习|實習)", False),
]
COOP_WORDS = [
    ("co-op", r"(?:co(?:\s*-\s*|\s+)op|coop)"),
    ("cooperative education", r"co(?:\s*-\s*|\s*)operative educat(?:ion|ional)"),
    ("work term", r"(?:cooperative )?work term student"),
]
# Roles that run internships, and clinical externs.
RECRUITS_INTERNS = r"(?:\b(?:talent acquisition|campus recruit(?:er|ing)|human resources)\b.*\bintern(?:ship)? (?:program )?(?:recruiting|hiring|coordination)\b|\bintern(?:ship)? (?:program )?(?:recruiting|hiring|coordinat(?:or|ion))\b)"
CLINICAL = r"\b(?:nurs(?:e|ing)|radiolog(?:y|ic)|pharmac(?:y|ist)|respiratory (?:care|therap(?:y|ist))|surgical (?:tech|technologist)|patient care|medical assistant|sonograph(?:y|er)|imaging technologist|clinical laboratory|laboratory technologist)\b"

# Employment types by their letters and digits.
TYPES = {
    "fulltime": "Full-time", "fulltimeemployee": "Full-time", "modifiedfulltime": "Full-time", "parttime": "Part-time", "temporary": "Temporary", "temp": "Temporary",
    "contractor": "Contractor", "contract": "Contract", "fixedtermcontract": "Contract", "coop": "Co-op", "coopfixedterm": "Co-op", "coopinternship": "Co-op",
    "cooperativeeducation": "Co-op", "cooperativeeducationstudent": "Co-op", "cooperativeworkterm": "Co-op", "workterm": "Co-op", "intern": "Internship", "internship": "Internship",
    "regular": "Regular", "employeeregular": "Regular", "employeeregularpermanent": "Regular", "permanent": "Permanent", "seasonal": "Seasonal", "casual": "Casual",
    "freelance": "Freelance", "apprentice": "Apprenticeship", "apprenticeship": "Apprenticeship", "fixedterm": "Fixed-term",
}
TYPE_PATTERNS = [("Full-time", "fulltime"), ("Part-time", "parttime"), ("Internship", "^intern(?:ship)?(?:position|program)?$"), ("Temporary", "^temp(?:orary)?(?:position|assignment)?$"), ("Fixed-term", "fixedterm")]
COOP_TYPE = r"(?i)(?:^|[^a-z])co\s*-?\s*op(?:[^a-z]|$)|\bcooperative\s+(?:education|work\s+term|term)\b|\bwork\s+term(?:\s+student)?\b"
REQUISITION = r"(?i)^(?:R|JR|REQ|JOB|POSITION)[-_]?\d{3,}$"
PROMOTION = r"(?i)^(?:spotlight|featured) job$"

# Recruiting cycles; the year is the group.
CYCLES = [
    r"\b(?:spring|summer|fall|autumn|winter)\s+(20\d{2})\b",
    r"\b(20\d{2})\s+(?:intern(?:s|ships?)?|co(?:\s*-\s*|\s+)op|coop)\b",
    r"\b(?:intern(?:s|ships?)?|co(?:\s*-\s*|\s+)op|coop)(?:\s+(?:program|position|role|start(?:ing)?))?\s+(?:in\s+)?(20\d{2})\b",
]

# Places.
US_NAMES = ["us", "u s", "usa", "u s a", "united states", "united states of america"]
NO_COUNTRY = ["", "remote", "global", "worldwide", "multiple", "various"]
NO_PLACE = ["remote", "location not specified", "multiple locations", "flexible any site"]
STATE_CODES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()
PROVINCE_CODES = "AB BC MB NB NL NS NT NU ON PE QC SK YT".split()
STATES = [
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky",
    "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york",
    "north carolina", "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia", "washington",
    "west virginia", "wisconsin", "wyoming", "district of columbia",
]
ELSEWHERE = [
    "canada", "mexico", "united kingdom", "england", "scotland", "wales", "ireland", "france", "germany", "spain", "italy", "netherlands", "switzerland", "sweden", "norway", "denmark", "finland", "poland",
    "romania", "hungary", "czech republic", "czechia", "austria", "belgium", "portugal", "greece", "india", "china", "hong kong", "singapore", "japan", "south korea", "korea", "taiwan", "australia",
    "new zealand", "brazil", "argentina", "chile", "colombia", "peru", "israel", "united arab emirates", "saudi arabia", "south africa", "philippines", "malaysia", "indonesia", "thailand", "vietnam",
    "karnataka", "bengaluru", "bangalore", "ontario", "quebec", "alberta", "british columbia", "manitoba", "new brunswick", "newfoundland and labrador", "nova scotia", "prince edward island",
    "saskatchewan", "northwest territories", "nunavut", "yukon",
]
PLACE_CODE = r",\s*([A-Z]{2})(?:\s*[,-]|\s+[A-Z]\d[A-Z]\s*\d[A-Z]\d|\s+\d{5}|$)"

# Signals of the AI and data topic, as (key, pattern), ASCII case ignored.
DOMAIN = [
    ("artificial intelligence", r"\bartificial intelligence\b"), ("machine learning", r"\bmachine learning\b"), ("deep learning", r"\bdeep learning\b"), ("generative ai", r"\b(?:generative ai|genai)\b"),
    ("large language model", r"\b(?:large language models?|llms?)\b"), ("natural language processing", r"\b(?:natural language processing|nlp)\b"), ("computer vision", r"\bcomputer vision\b"),
    ("reinforcement learning", r"\breinforcement learning\b"), ("recommendation systems", r"\brecommend(?:ation|er) systems?\b"), ("data science", r"\bdata scien(?:ce|tist|tists)\b"),
    ("decision scientist", r"\bdecision scientists?\b"), ("applied scientist", r"\bapplied scientists?\b"), ("research scientist", r"\bresearch scientists?\b"), ("data engineering", r"\bdata engineer(?:ing|s)?\b"),
    ("analytics engineering", r"\banalytics? engineer(?:ing|s)?\b"), ("data analysis", r"\bdata (?:analysis|analyst|analysts|analytics)\b"), ("data analytics", r"\bdata\s*(?:&(?:amp;)?|and)\s*analytics\b"),
    ("business intelligence", r"\bbusiness intelligence\b"), ("ml engineering", r"\bml engineer(?:ing|s)?\b"), ("mlops", r"\bmlops\b"), ("model infrastructure", r"\bmodel infrastructure\b"),
    ("ai platform", r"\bai platform\b"), ("data platform", r"\bdata platform\b"),
]
SUPPORTING = [
    ("ai", r"(^|[^a-z0-9])ai([^a-z0-9]|$)"), ("ml", r"(^|[^a-z0-9])ml([^a-z0-9]|$)"), ("bi", r"(^|[^a-z0-9])bi([^a-z0-9]|$)"), ("predictive models", r"\bpredictive model(?:ing|s)?\b"),
    ("feature engineering", r"\bfeature engineering\b"), ("model training", r"\b(?:model training|training models?)\b"), ("statistical modeling", r"\bstatistical model(?:ing|s)?\b"), ("data pipeline", r"\bdata pipelines?\b"),
]
TOOLS = [("pytorch", r"\bpytorch\b"), ("tensorflow", r"\btensorflow\b"), ("scikit-learn", r"\bscikit[ -]?learn\b"), ("hugging face", r"\bhugging ?face\b")]

# Signals of the areas, as (label, pattern), ASCII case ignored.
AREAS = {
    "ai-ml": [
        ("artificial intelligence", r"\bartificial intelligence\b"), ("ai", r"(^|[^a-z0-9])ai([^a-z0-9]|$)"), ("machine learning", r"\bmachine learning\b"), ("ml", r"(^|[^a-z0-9])ml([^a-z0-9]|$)"),
        ("deep learning", r"\bdeep learning\b"), ("generative ai", r"\b(?:generative ai|genai)\b"), ("large language model", r"\b(?:large language models?|llms?)\b"),
        ("natural language processing", r"\b(?:natural language processing|nlp)\b"), ("computer vision", r"\bcomputer vision\b"), ("reinforcement learning", r"\breinforcement learning\b"),
        ("applied scientist", r"\bapplied scientists?\b"), ("research scientist", r"\bresearch scientists?\b"), ("pytorch", r"\bpytorch\b"), ("tensorflow", r"\btensorflow\b"), ("scikit-learn", r"\bscikit[ -]?learn\b"),
    ],
    "data-analytics": [
        ("data science", r"\bdata scien(?:ce|tist|tists)\b"), ("data engineering", r"\bdata engineer(?:ing|s)?\b"), ("data analytics", r"\bdata\s*(?:&(?:amp;)?|and)\s*analytics\b"),
        ("data analysis", r"\bdata (?:analysis|analyst|analysts|analytics)\b"), ("analytics", r"\banalytics?\b"), ("quantitative", r"\bquantitative\b"), ("quant", r"(^|[^a-z0-9])quant([^a-z0-9]|$)"),
        ("informatics", r"\binformatics\b"), ("business intelligence", r"\bbusiness intelligence\b"), ("statistics", r"\bstatistic(?:al|ian|ians|s)?\b"), ("operations research", r"\boperations research\b"),
        ("decision science", r"\bdecision scien(?:ce|tist|tists)\b"),
    ],
    "software-engineering": [
        ("software engineering", r"\bsoftware engineer(?:ing|s)?\b"), ("software intern", r"\bsoftware (?:engineering )?(?:interns?|internships?|co[ -]?ops?)\b"), ("software developer", r"\bsoftware developers?\b"),
        ("software development", r"\bsoftware development\b"), ("application developer", r"\bapplications? developers?\b"), ("frontend", r"\bfront[ -]?end (?:software )?(?:engineer|developer)s?\b"),
        ("backend", r"\bback[ -]?end (?:software )?(?:engineer|developer)s?\b"), ("full stack", r"\bfull[ -]?stack (?:software )?(?:engineer|developer)s?\b"),
        ("mobile", r"\bmobile (?:software )?(?:engineer|developer)s?\b"), ("ios", r"\bios (?:software )?(?:engineer|developer)s?\b"), ("android", r"\bandroid (?:software )?(?:engineer|developer)s?\b"),
        ("firmware", r"\bfirmware (?:engineer|developer)s?\b"),
    ],
}
DATA_TRACK = [("data track", r"(^|[^a-z0-9])data([^a-z0-9]|$)")]
#: The texts have single spaces.
TRACK_LEAD = r"(?:assignments? (?:include|including|in|across|within|may include)|disciplines? (?:such as|include|including|in)|tracks? ?(?:include|including|such as|:|in)|(?:focus|practice) areas? ?(?:include|including|such as|:|in)|rotations? (?:include|including|through|across|in)|(?:gain(?:ing)? )?experience within)"
#: With their least lengths.
INCIDENTAL = [("responsible use", 15), ("usage policy", 12), ("candidate experience", 20), ("recruiting", 10), ("recruitment", 11), ("hiring decisions?", 15), ("drafting assistance", 19), ("content organization", 20)]

# Hosts of applicant tracking systems, as (adapter, part of the url), the first that fits.
ADAPTERS = [
    ("greenhouse", "greenhouse.io"), ("lever", "lever.co"), ("workday", "myworkdayjobs"), ("workday", "myworkdaysite"), ("ashby", "ashbyhq.com"), ("icims", "icims.com"),
    ("phenom", "phenompeople"), ("phenom", "/search-results"), ("dayforce", "dayforcehcm.com"), ("smartrecruiters", "smartrecruiters.com"),
]

# The resume score, as (code, points, pattern).
ROLES = [
    ("role:applied-science", 35, r"(?:applied scientist|research scientist)"),
    ("role:llm-nlp", 35, r"(?:\bllm\b|large language model|natural language|\bnlp\b|retrieval augmented|\brag\b|knowledge graph|agentic|ai evaluation)"),
    ("role:ai-ml", 35, r"(?:machine learning|artificial intelligence|\bai\b|deep learning|applied ai)"),
    ("role:data-engineering", 35, r"(?:data engineer|analytics engineer|etl engineer|data platform)"),
    ("role:data-analytics", 35, r"(?:data scien|data analy|business intelligence|quantitative|\bbi\b)"),
    ("role:computer-vision", 35, r"(?:computer vision|image processing|\bocr\b)"),
    ("role:software-engineering", 35, r"(?:software (?:engineer|engineering|developer|development)|application developer|backend developer|frontend developer|full.?stack developer)"),
    ("role:data-analytics", 30, r"(?:fraud|anti money laundering|\baml\b|risk analy|regtech|data quality)"),
]
SKILLS = [
    ("skill:python", 10, r"(?:^|\s)(?:python|pyspark|pandas)(?:\s|$)"),
    ("skill:sql", 10, r"(?:^|\s)(?:sql|database|data warehouse|etl|hadoop|mongodb)(?:\s|$)"),
    ("skill:ml", 7, r"(?:machine learning|deep learning|scikit|pytorch|tensorflow)"),
    ("skill:language-systems", 10, r"(?:\bnlp\b|large language model|\bllm\b|\brag\b|neo4j|knowledge graph|model evaluation)"),
    ("skill:software", 25, r"(?:javascript|typescript|java|c\+\+|react|node\.js)"),
    ("skill:analytics", 5, r"(?:tableau|business intelligence|analytics)"),
    ("skill:vision", 8, r"(?:opencv|computer vision|image processing|\bocr\b|multimodal)"),
]
DOMAINS = [
    ("domain:aml-risk", 15, r"(?:anti money laundering|\baml\b|\bkyc\b|fraud|financial crime|regtech|compliance analy|risk analy|data quality)"),
    ("domain:applied-data", 12, r"(?:supply chain|graph analy|information extraction|document intelligence)"),
]
EDUCATION = [
    ("education:masters-eligible", 10, r"(?:master(?: s)?|graduate students?|graduate degree)"),
    ("education:relevant-degree", 8, r"(?:bachelor(?: s)?|college|university|undergraduate|computer science|data science|engineering|information technology)"),
]
RECRUITING_TITLE = r"(?:^|\s)(?:recruiting|recruiter|talent acquisition|human resources|campus recruiter)(?:\s|$)"
OTHER_TITLE = r"(?:^|\s)(?:marketing|sales|accounting|clinical|communications?|human resources|operations)(?:\s|$)"
HIGH_SCHOOL = r"(?:^|\s)(?:high school|secondary school)(?:\s|$)"
HIGH_SCHOOL_TITLE = r"(?:students?|interns?|program)"
HIGH_SCHOOL_ONLY = r"(?:only|exclusively) (?:for )?(?:high school|secondary school)"
HIGHER_EDUCATION = r"(?:bachelor(?: s)?|college|university|undergraduate|graduate|master(?: s)?|ph\.?d\.?|doctoral)"
DOCTORAL = r"(?:^|\s)(?:ph\.?d\.?|doctoral)(?:\s|$)"
DOCTORAL_ONLY = r"(?:ph\.?d\.?|doctoral) (?:students?|candidates?) (?:only|required)|(?:only|exclusively) (?:for )?(?:ph\.?d\.?|doctoral)"
BELOW_DOCTORAL = r"(?:bachelor(?: s)?|college|university|undergraduate|master(?: s)?|graduate students?|graduate degree)"
CITIZENS = r"(?:must|required to) (?:be )?(?:a )?(?:u\.?s\.?|united states) citizen|u\.?s\.? citizenship (?:is )?required"
CLEARANCE = r"active (?:secret|top secret|ts\/?sci|security) clearance|(?:secret|top secret|ts\/?sci) clearance required"

# Patterns of links, paths, hosts and texts of career pages, as they must match; case does not count.
JOB_DETAIL_ANCHOR = r"(?i)(?:\/(?:jobs?|positions?|openings?|vacanc(?:y|ies))\/[^/?#]{3,}|\/job\.html\?[^#]*\bid=|\/job-detail\?[^#]*\bjob=|\/job-opening\.php\?[^#]*\breq=|\/career-application\/?\?[^#]*\bjobtitle=|\/careers\/(?:jobdetail|details)\/|\/careers\/[^?#]*(?:\d{4,}|[a-z]{1,4}-\d{3,})|\/corporate-careers\/jr-\d+\/[^/?#]+|\/search\/jobdetail\/[^/?#]+|\/careersmarketplace\/(?:pipeline|job)detail\/|\/company-job\/description\/reqid\/[^/?#]+|\/job\/detail\/[^/?#]+|\/[^/?#]+\/[^/?#]+\/[a-f0-9]{24,}\/job\/?(?:[?#]|$)|[?&](?:jobid|job_id|gh_jid|reqid|requisitionid|pid|opportunityid|joborderid|selectedposition)=)"
LISTING_ONLY = r"(?i)(?:search-jobs?|search-results|viewalljobs|job-opportunities|join(?:talent|[-_/]our[-_/]team)|talent-community|jobcart|jobs?\/(?:search|login)|positions?\/{1,2}filter)(?:[/?#]|$)"
CAREER_CONTENT_ONLY = r"(?i)\/careers?\/(?:open-positions|view-jobs(?:\.html)?|jobs|culture|benefits)\/?(?:[?#].*)?$"
GENERIC_TEXT = r"(?i)^(?:apply|apply now|form|here\.?|learn more(?: about this position)?\s*[>›»]?|read more|view .+|see .+|explore .+|join .+|details|search .+ jobs?|careers?|career website|jobs?|benefits|student programs|open (?:positions?|roles)|skip to (?:main )?(?:jobs search results|content)\.?|click here|(?:first|previous|next|last) page of results(?: first| last)?|page \d+ of \d+(?:\s*,\s*current page)?|your privacy choices|privacy notice|manage cookie preferences|notify me of new jobs|create (?:an? )?(?:job )?alert|share your information|get in touch!?|join (?:our )?talent (?:community|network)|candidate (?:pool|profile)|internal careers site|returning applicant login|i am an employee|sign in|log in|view profile|stay connected|terms of use|total rewards|events?(?: \d+)?|sitemap|job search tool|chinese \((?:simplified|traditional)\)|french|german|italian|japanese|portuguese|spanish|next|previous)$"
EXTERNAL_BOARDS = r"(?i)(?:greenhouse\.io|lever\.co|myworkdayjobs\.com|myworkdaysite\.com|smartrecruiters\.com|ashbyhq\.com|icims\.com|jobvite\.com|hirebridge\.com|taleo\.net|selectminds\.com|apply\.workable\.com|bamboohr\.com|pinpointhq\.com|teamtailor\.com|jobs\.gusto\.com|ats\.rippling\.com|dayforcehcm\.com|successfactors\.(?:com|eu)|oraclecloud\.com|eightfold\.ai|avature\.net|(?:myjobs|workforcenow)\.adp\.com|recruiting\.paylocity\.com|recruiting\d*\.ultipro\.com)"
ROLE_TITLE = r"(?i)\b(?:accountant|administrator|analyst|architect|associate|consultant|coordinator|counsel|developer|director|engineer|executive|intern|lead|manager|officer|principal|recruiter|representative|researcher|scientist|specialist|supervisor|technician)\b"
ORACLE_JOB = r"(?i)\/hcmUI\/CandidateExperience\/(?:[^/]+\/)sites\/[^/]+\/job\/[^/?#]+\/?$"
ORACLE_SITEMAPS = r"(?i)\/hcmUI\/CandidateExperience\/sitemaps(?:\/|$)"
ORACLE_EVENTS = r"(?i)\/hcmUI\/CandidateExperience\/(?:[^/]+\/)sites\/[^/]+\/(?:events|join-talent-community)(?:\/|$)"
ORACLE_DEEPLINK = r"(?i)\/fscmUI\/faces\/deeplink$"
ORACLE_SEARCH = r"(?i)ICE_JOB_SEARCH_RESP"
JOBVITE_HOST, JOBVITE_PATH = r"(?i)^(?:www\.)?jobs\.jobvite\.com$", r"(?i)^\/[^/?#]+\/job\/[^/?#]+\/?$"
LEVER_HOST, ASHBY_HOST, TWO_PARTS = r"(?i)lever\.co$", r"(?i)ashbyhq\.com$", r"(?i)^\/[^/?#]+\/[^/?#]+\/?$"
SMART_HOST, SMART_PATH = r"(?i)smartrecruiters\.com$", r"(?i)^\/[^/?#]+\/\d+(?:[-/][^/?#]+)?\/?$"
GUSTO_HOST, GUSTO_PATH = r"^jobs\.gusto\.com$", r"(?i)^\/postings\/[^/?#]+-[a-f\d]{8}(?:-[a-f\d]{4}){3}-[a-f\d]{12}\/?$"
IGNORED_SEGMENT = r"(?i)^(?:job|jobs|career|careers|company|talent|opening|openings|position|positions|role|roles|search|login|userhome|all-jobs|open-roles|current-openings|explore|join|programs?|benefits|culture|teams?|early-career)$"
ATS_HOST = r"(?i)(?:greenhouse\.io|lever\.co|myworkdayjobs\.com|myworkdaysite\.com|smartrecruiters\.com|ashbyhq\.com|icims\.com|jobvite\.com|hirebridge\.com|taleo\.net|brassring\.com|apply\.workable\.com|bamboohr\.com|pinpointhq\.com|teamtailor\.com|jobs\.gusto\.com|ats\.rippling\.com|csod\.com|dayforcehcm\.com|successfactors\.(?:com|eu)|oraclecloud\.com|eightfold\.ai|avature\.net|(?:myjobs|workforcenow)\.adp\.com|recruiting\.paylocity\.com|recruiting\d*\.ultipro\.com)"
JOB_TEXT = r"(?i)\b(?:jobs?|careers?|opportunities|open (?:positions|roles)|join (?:our )?team|search roles?)\b"
JOB_PATH = r"(?i)\/(?:jobs?|careers?|opportunities|positions?|openings?|search-results|search\/results|job-search|open-positions|join-us)(?:\/|$|[?#-])"
USER_ONLY = r"(?i)(?:job-?alerts?|talent-?community|introduceyourself|sign[_-]?in|\/login|\/connect(?:[/?#]|$)|\/apply(?:[/?#]|$))"
JOB_DETAIL = r"(?i)(?:\/(?:job|jobs)\/[^/?#]+(?:\/[^/?#]+)?(?:[?#]|$)|[?&](?:pid|jobid|jobseqno|gh_jid)=)"
NON_LISTING_PATH = r"(?i)(?:career-areas?|early-careers?|students?|university|\/blog(?:\/|$)|jobcart|job-seeker-(?:resources|support)|career-progression|working-at|talent-community|jointalentcommunity|\/bca(?:\/|$)|loans?)"
ATS_VENDOR_LANDING = r"(?i)^(?:www\.)?(?:ashbyhq\.com|lever\.co|eightfold\.ai|bamboohr\.com)$"
SOCIAL_HOST = r"(?i)linkedin\.com|indeed\.com|glassdoor\.com|facebook\.com|instagram\.com|twitter\.com|x\.com"
SEARCH_TEXT = r"(?i)\b(?:search|view|explore|see)\s+(?:all\s+)?(?:open\s+)?(?:jobs?|roles?|opportunities)\b"
SEARCH_PATH = r"(?i)\/(?:search-jobs|job-search-results|viewalljobs|search)\/?(?:[?#]|$)"
NICHE_TEXT = r"(?i)\b(?:sales|nursing|engineering|accounting|finance|college|internship)\s+(?:jobs?|careers?)\b"
NICHE_PATH = r"(?i)\/(?:sales|nursing|engineering|accounting|finance|college|internship)[-/](?:jobs?|careers?)(?:[/?#]|$)"
SEARCH_ENGINE = r"(?i)(?:^|\.)bing\.com$"
DOCUMENT_URL = r"(?i)\.(?:pdf|docx?)(?:[?#]|$)"
NAVIGATION_TITLE = r"(?i)^(?:home|sites|university|university overview|recruitment fraud|saved jobs(?:\s*0)?|go to saved jobs(?:\s*0)?|know your rights|job listing|students and graduates|events?(?:\s*\d+)?|sitemap|i am an employee|skip to main content\.?)$"
NAVIGATION_URL = r"(?i)\/hcmUI\/CandidateExperience\/sitemaps(?:\/|$)|\/sites\/[^/]+\/events(?:\/|$)|\/fscmUI\/faces\/deeplink[^#]*ICE_JOB_SEARCH_RESP"
THIRD_PARTY_AGGREGATOR = r"(?i)(?:^|\.)(?:indeed\.com|glassdoor\.com|linkedin\.com|ziprecruiter\.com|gotocareer\.io|ev\.careers)$"
# Words that name no company.
COMPANY_STOP_WORDS = ["company", "corporation", "corp", "group", "holdings", "holding", "international", "services", "service", "technologies", "technology", "financial", "health", "healthcare", "bank", "systems", "system", "united", "america", "american"]
# Titles of pages that are no postings.
NON_JOB_TITLE = r"(?i)^(?:privacy notice|create (?:an? )?(?:job )?alert|share your information|get in touch!?|join (?:our )?talent (?:community|network)|candidate (?:pool|profile)|sign in|log in|view profile|apply now)$"
# What evidence of the resume score is called, by code and, where a code has two names, points.
EVIDENCE_LABELS = {
    "role:applied-science": "Applied or research scientist role", "role:llm-nlp": "LLM, NLP, RAG, or knowledge systems", "role:ai-ml": "AI or machine learning role", "role:data-engineering": "Data engineering role",
    "role:data-analytics": "Data science or analytics role", "role:data-analytics:30": "Risk or fraud analytics role", "role:computer-vision": "Computer vision or OCR role", "role:software-engineering": "Direct software engineering role",
    "skill:python": "Python, PySpark, or Pandas", "skill:sql": "SQL and data systems", "skill:ml": "Machine-learning stack", "skill:language-systems": "Language or knowledge systems", "skill:software": "Software development stack",
    "skill:analytics": "Analytics tooling", "skill:vision": "Computer vision or OCR stack", "domain:aml-risk": "AML, risk, fraud, or data-quality domain", "domain:applied-data": "Applied data and information systems domain",
    "education:masters-eligible": "Master's or graduate students eligible", "education:relevant-degree": "Relevant technical degree", "year:2027": "2027 recruiting cycle", "freshness:published": "ATS posting date available",
}
