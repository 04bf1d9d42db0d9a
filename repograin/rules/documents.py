# Documentation sections, technologies, commands, claims.

# In match order.
SECTIONS = [
    ("Description", r"(?i)^#+\s*(description|about|overview|what\s+is)"),
    ("Installation", r"(?i)^#+\s*(installation|install|setup|getting\s+started)"),
    ("Usage", r"(?i)^#+\s*(usage|how\s+to\s+use|quick\s+start|examples?)"),
    ("Api", r"(?i)^#+\s*(api|reference|endpoints?)"),
    ("Architecture", r"(?i)^#+\s*(architecture|design|structure)"),
    ("Contributing", r"(?i)^#+\s*(contributing|development|contribute)"),
    ("Changelog", r"(?i)^#+\s*(changelog|changes|history)"),
    ("License", r"(?i)^#+\s*(license|licensing)"),
    ("Examples", r"(?i)^#+\s*(examples?|samples?)"),
    ("Configuration", r"(?i)^#+\s*(configuration|config|settings)"),
    ("Troubleshooting", r"(?i)^#+\s*(troubleshooting|faq|problems?)"),
]
KEPT_SECTIONS = ["Description", "Installation", "Usage", "Api", "Architecture", "Contributing"]
EXPECTED_SECTIONS = [
    "Description", "Installation", "Usage", "Api", "Architecture", "Contributing", "Examples", "Configuration",
]

TECHNOLOGIES = [
    ("React", r"(?i)\b(react|jsx|reactjs)\b"),
    ("Next.js", r"(?i)\b(next\.?js|nextjs)\b"),
    ("Vue.js", r"(?i)\b(vue\.?js|vuejs)\b"),
    ("Angular", r"(?i)\b(angular|ng-)\b"),
    ("Node.js", r"(?i)\b(node\.?js|nodejs|npm|yarn)\b"),
    ("Express", r"(?i)\b(express\.?js|expressjs)\b"),
    ("NestJS", r"(?i)\b(nest\.?js|nestjs)\b"),
    ("Spring Boot", r"(?i)\b(spring\s+boot|springboot)\b"),
    ("Django", r"(?i)\bdjango\b"),
    ("Flask", r"(?i)\bflask\b"),
    ("FastAPI", r"(?i)\b(fastapi|fast\s+api)\b"),
    ("Docker", r"(?i)\b(docker|dockerfile|docker-compose)\b"),
    ("Kubernetes", r"(?i)\b(kubernetes|k8s|kubectl)\b"),
    ("PostgreSQL", r"(?i)\b(postgresql|postgres|psql)\b"),
    ("MySQL", r"(?i)\bmysql\b"),
    ("MongoDB", r"(?i)\bmongodb\b"),
    ("Redis", r"(?i)\bredis\b"),
    ("GraphQL", r"(?i)\bgraphql\b"),
    ("REST API", r"(?i)\b(rest|restful)\s+(api|service)\b"),
    ("TypeScript", r"(?i)\btypescript\b"),
    ("Python", r"(?i)\bpython\b"),
    ("Java", r"(?i)\bjava\b"),
    ("Go", r"(?i)\b(golang|go\s+lang)\b"),
    ("Rust", r"(?i)\brust\b"),
]

PURPOSES = {
    "React": "Frontend UI Framework",
    "Vue.js": "Frontend UI Framework",
    "Angular": "Frontend UI Framework",
    "Next.js": "Full-stack React Framework",
    "Node.js": "JavaScript Runtime",
    "Express": "Backend Web Framework",
    "NestJS": "Backend Web Framework",
    "Spring Boot": "Java Web Framework",
    "Django": "Python Web Framework",
    "Flask": "Python Web Framework",
    "FastAPI": "Python Web Framework",
    "Docker": "Containerization",
    "Kubernetes": "Container Orchestration",
    "PostgreSQL": "Database",
    "MySQL": "Database",
    "MongoDB": "Database",
    "Redis": "Caching/Message Broker",
    "GraphQL": "API Query Language",
    "TypeScript": "Type-safe JavaScript",
}
PURPOSE_WORDS = [("Database Technology", ["database"]), ("API Technology", ["api"])]
DEFAULT_PURPOSE = "Development Tool"

VERSION_PATTERNS = [
    r"v?(\d+\.\d+(?:\.\d+)?)",
    r"@(\d+\.\d+(?:\.\d+)?)",
    r"version\s*[:\-]\s*(\d+\.\d+(?:\.\d+)?)",
]
INSTALL_METHODS = [
    ("npm", r"npm\s+install"),
    ("yarn", r"yarn\s+add"),
    ("pip", r"pip\s+install"),
    ("maven", r"mvn\s+install"),
    ("gradle", r"gradle"),
    ("cargo", r"cargo"),
    ("docker", r"docker"),
]
CONFIG_WORDS = ["config", "configure", "setup", "environment", "settings"]
SETUP_COMMANDS = [
    r"(?i)\b(npm|yarn)\s+(install|i)\b",
    r"(?i)\bpip\s+install\b",
    r"(?i)\bmvn\s+(clean\s+)?install\b",
    r"(?i)\bgradle\s+build\b",
    r"(?i)\bcargo\s+build\b",
    r"(?i)\bmake\s+(install|build)\b",
    r"(?i)\bdocker\s+(build|run)\b",
    r"(?i)\bgit\s+clone\b",
]

CLAIMS = [
    ("Feature", [
        r"(?i)\b(supports?|provides?|includes?|features?)\s+([^.!?]+)",
        r"(?i)\b(authentication|authorization|oauth|sso|login)\b",
        r"(?i)\b(user\s+management|user\s+registration|user\s+profiles?)\b",
        r"(?i)\b(real[\s-]?time|notifications?|messaging)\b",
        r"(?i)\b(payments?|billing|subscriptions?)\b",
    ]),
    ("Api", [
        r"(?i)\b(rest\s+api|restful|api\s+endpoints?)\b",
        r"(?i)\b(graphql|grpc|websocket)\b",
        r"(?i)\b(crud\s+operations?|create|read|update|delete)\b",
        r"(?i)\b(json\s+api|xml\s+api)\b",
    ]),
    ("Integration", [
        r"(?i)\b(integrates?\s+with|connects?\s+to)\s+([^.!?]+)",
        r"(?i)\b(stripe|paypal|twilio|sendgrid|mailchimp)\b",
        r"(?i)\b(social\s+media|facebook|twitter|google|github)\b",
        r"(?i)\b(third[\s-]?party|external\s+services?)\b",
    ]),
    ("Technology", [
        r"(?i)\b(built\s+with|using|powered\s+by)\s+([^.!?]+)",
        r"(?i)\b(react|vue|angular|node\.js|express|fastify)\b",
        r"(?i)\b(mongodb|postgresql|mysql|redis|elasticsearch)\b",
        r"(?i)\b(docker|kubernetes|aws|azure|gcp)\b",
    ]),
    ("Security", [
        r"(?i)\b(secure|security|encrypted?|encryption)\b",
        r"(?i)\b(ssl|tls|https|certificates?)\b",
        r"(?i)\b(end[\s-]?to[\s-]?end|e2e|zero[\s-]?trust)\b",
        r"(?i)\b(gdpr|hipaa|compliance|audit)\b",
    ]),
    ("Performance", [
        r"(?i)\b(fast|performance|scalable?|scalability)\b",
        r"(?i)\b(\d+)\s+(concurrent\s+)?(users?|requests?|connections?)\b",
        r"(?i)\b(caching|cdn|optimization|load\s+balancing)\b",
    ]),
    ("Capability", [
        r"(?i)\b(can|able\s+to|capability|capabilities)\s+([^.!?]+)",
        r"(?i)\b(mobile[\s-]?friendly|responsive|cross[\s-]?platform)\b",
        r"(?i)\b(offline\s+support|progressive\s+web\s+app|pwa)\b",
    ]),
    ("Deployment", [
        r"(?i)\b(deploy|deployment|hosting|hosted)\b",
        r"(?i)\b(docker|kubernetes|heroku|vercel|netlify)\b",
        r"(?i)\b(ci/cd|continuous\s+integration|continuous\s+deployment)\b",
    ]),
]
# hundredths of a point
CLAIM_BASE = 50
CLAIM_TYPE_BONUS = {"Feature": 20, "Api": 20, "Security": 30, "Integration": 10}
CLAIM_OTHER_BONUS = 5
KEYWORD_BONUS = {
    "authentication": 10, "oauth": 9, "api": 8, "crud": 8, "secure": 9, "integration": 7, "real-time": 8,
}
# claim type -> (priority, context words); first match wins, then the default
CLAIM_PRIORITY_WORDS = {
    "Api": [("Critical", ["authentication", "authorization"]), ("High", ["crud", "rest"])],
    "Feature": [("Critical", ["authentication", "user management"]), ("High", ["payment", "notification"])],
}
CLAIM_PRIORITY = {
    "Security": "Critical", "Api": "Medium", "Feature": "Medium", "Integration": "High", "Performance": "Medium",
    "Technology": "Medium", "Capability": "Medium", "Deployment": "Low",
}
VERIFIED_TYPES = ["Feature", "Api", "Security"]
CLAIM_THRESHOLD = 60
