# Implementation evidence patterns, dependency map, phrases,
# conflict mapping, CRUD patterns, status weights.

EVIDENCE = [
    ("AuthenticationImplemented", [
        r"(?i)\b(jwt|jsonwebtoken|passport|oauth|session|cookie|auth|login|logout)\b",
        r"(?i)\b(bcrypt|scrypt|argon2|hash|salt|verify)\b",
        r"(?i)\b(authenticate|authorize|isAuthenticated|requireAuth)\b",
        r"(?i)\b(token|bearer|authorization|credentials)\b",
        r"(?i)class\s+\w*Auth\w*|function\s+\w*Auth\w*",
        r"(?i)@PreAuthorize|@Secured|@RolesAllowed",
    ]),
    ("ApiEndpointsImplemented", [
        r"(?i)@(Get|Post|Put|Delete|Patch)Mapping|@RequestMapping",
        r"(?i)@(GET|POST|PUT|DELETE|PATCH)\s*\(|@Path\s*\(",
        r"(?i)app\.(get|post|put|delete|patch)\s*\(|router\.(get|post|put|delete|patch)\s*\(",
        r"(?i)@RestController|@Controller|@Resource",
        r"(?i)class\s+\w*Controller|class\s+\w*Resource|class\s+\w*Handler",
        r"(?i)def\s+(get|post|put|delete|patch)_\w+|async\s+def\s+(get|post|put|delete|patch)_\w+",
    ]),
    ("DatabaseIntegration", [
        r"(?i)@Entity|@Table|@Column|@Id|@GeneratedValue",
        r"(?i)@Repository|@Service|@Transactional",
        r"(?i)class\s+\w*(Model|Entity|Schema)\b|def\s+\w*(Model|Entity|Schema)\b",
        r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|CREATE TABLE|ALTER TABLE)\b",
        r"(?i)\b(save|find|update|delete|query|execute)\s*\(|\.save\(\)|\.find\(\)",
        r"(?i)(mongoose|sequelize|typeorm|prisma|sqlalchemy|django\.db)",
    ]),
    ("SecurityImplemented", [
        r"(?i)\b(encrypt|decrypt|cipher|hash|sanitize|validate|escape)\b",
        r"(?i)\b(cors|csrf|xss|injection|sql.*injection)\b",
        r"(?i)\b(https|ssl|tls|certificate)\b",
        r"(?i)@Valid|@NotNull|@Size|@Pattern|@Email",
        r"(?i)(helmet|express-rate-limit|csurf)",
        r"(?i)(input.*validation|parameter.*validation|request.*validation)",
    ]),
    ("IntegrationImplemented", [
        r"(?i)\b(axios|fetch|http|rest|api)\s*\.|\.get\(|\.post\(|\.put\(|\.delete\(",
        r"(?i)(stripe|paypal|twilio|sendgrid|mailchimp|slack|discord)",
        r"(?i)@FeignClient|@WebServiceClient|RestTemplate|WebClient",
        r"(?i)webhook|callback|integration|external.*service",
        r"(?i)(oauth|sso|social.*login|third.*party)",
    ]),
    ("PerformanceOptimized", [
        r"(?i)\b(cache|redis|memcache|async|await|promise|thread|pool)\b",
        r"(?i)@Cacheable|@CacheEvict|@EnableCaching",
        r"(?i)(index|constraint|foreign.*key|primary.*key)",
        r"(?i)(lazy.*load|eager.*load|pagination|limit|offset)",
        r"(?i)(compress|minify|optimize|performance)",
    ]),
    ("TestingImplemented", [
        r"(?i)@Test|@TestCase|@Before|@After|@BeforeEach|@AfterEach",
        r"(?i)\b(test|spec|describe|it|should|expect|assert)\b",
        r"(?i)(junit|testng|pytest|jest|mocha|jasmine|rspec)",
        r"(?i)class\s+\w*Test|def\s+test_\w+|function\s+test\w+",
        r"(?i)(mock|stub|spy|fixture|setUp|tearDown)",
    ]),
    ("DeploymentReady", [
        r"(?i)FROM\s+\w+|COPY|RUN|CMD|ENTRYPOINT",
        r"(?i)(docker|kubernetes|helm|compose)",
        r"(?i)(ci|cd|github.*actions?|jenkins|gitlab.*ci)",
        r"(?i)(deploy|deployment|infrastructure|terraform)",
        r"(?i)(environment|env|config|settings)",
    ]),
]
PHRASES = {
    "AuthenticationImplemented": "Authentication system with",
    "ApiEndpointsImplemented": "API endpoints providing",
    "DatabaseIntegration": "Database integration with",
    "SecurityImplemented": "Security measures including",
    "IntegrationImplemented": "Third-party integration with",
    "PerformanceOptimized": "Performance optimization using",
    "TestingImplemented": "Testing implementation with",
    "DeploymentReady": "Deployment configuration for",
}
DEPENDENCY_TYPE = {
    "spring-security": "AuthenticationImplemented",
    "passport": "AuthenticationImplemented",
    "jsonwebtoken": "AuthenticationImplemented",
    "bcrypt": "AuthenticationImplemented",
    "express": "ApiEndpointsImplemented",
    "fastapi": "ApiEndpointsImplemented",
    "spring-boot-starter-web": "ApiEndpointsImplemented",
    "mongoose": "DatabaseIntegration",
    "sequelize": "DatabaseIntegration",
    "prisma": "DatabaseIntegration",
    "stripe": "IntegrationImplemented",
    "twilio": "IntegrationImplemented",
    "redis": "PerformanceOptimized",
    "jest": "TestingImplemented",
    "junit": "TestingImplemented",
}
DEPENDENCY_POINTS = 70
# hundredths -> level
LEVELS = [(80, "Complete"), (50, "Partial"), (20, "Skeleton")]
LOWEST_LEVEL = "Placeholder"

CLAIM_TO_EVIDENCE = {
    "Feature": "AuthenticationImplemented",
    "Api": "ApiEndpointsImplemented",
    "Integration": "IntegrationImplemented",
    "Security": "SecurityImplemented",
    "Performance": "PerformanceOptimized",
    "Technology": "DatabaseIntegration",
    "Deployment": "DeploymentReady",
}
# hundredths
PRIORITY_WEIGHT = {"Critical": 40, "High": 30, "Medium": 20, "Low": 10}
LEVEL_GAP = {"Complete": 0, "Partial": 20, "Skeleton": 50, "Placeholder": 80}
ACTIONS = {
    "PreferCode": "Use code analysis results; update documentation to match",
    "PreferDocumentation": "Use documentation claims; implement missing features",
    "Merge": "Combine information from both sources",
    "FlagAsInconsistent": "Manual review required - significant discrepancy detected",
}
IMPACTS = {
    "ClaimedButNotImplemented": "Users may expect functionality that doesn't exist",
    "ImplementedButNotClaimed": "Users may not be aware of available functionality",
}
DEFAULT_IMPACT = "May cause confusion for users and developers"

IMPACT_SCORE = {"Critical": 100, "High": 80, "Medium": 50, "Low": 20}
COMPLEXITY_BY_CLAIM = {"Security": "High", "Integration": "High", "Api": "Medium"}
DEFAULT_COMPLEXITY = "Low"
EASE_SCORE = {"Low": 80, "Medium": 60, "High": 30}
EFFORT_BY_COMPLEXITY = {"High": "Large", "Medium": "Medium", "Low": "Small"}
TIMELINE = {
    ("Critical", "Low"): "Next sprint",
    ("Critical", "Medium"): "Within 2 sprints",
    ("Critical", "High"): "Within 1 month",
    ("High", "Low"): "Within 2 sprints",
    ("High", "Medium"): "Within 1 month",
    ("High", "High"): "Within 2 months",
    ("Medium", "Low"): "Within 3 months",
    ("Medium", "Medium"): "Within 3 months",
    ("Medium", "High"): "Within 3 months",
    ("Low", "Low"): "When capacity allows",
    ("Low", "Medium"): "When capacity allows",
    ("Low", "High"): "When capacity allows",
}

ANALYZER_WEIGHTS = {"CRUD Analyzer": 25, "Auth Analyzer": 20, "API Analyzer": 20, "Database Analyzer": 15, "Feature Analyzer": 15}

CRUD = [
    ("create", [
        r"(?i)\b(create|insert|add|save|post|new)\b.*\b(user|product|order|item|entity)\b",
        r"(?i)\b(User|Product|Order|Item)\.create\b",
        r"(?i)\.save\(\)",
        r"(?i)INSERT\s+INTO",
        r"(?i)@PostMapping|@Post|app\.post|router\.post",
        r"(?i)def\s+create_|function\s+create|createUser|createProduct",
    ]),
    ("read", [
        r"(?i)\b(get|find|read|fetch|retrieve|select|show)\b.*\b(user|product|order|item|entity)\b",
        r"(?i)\b(User|Product|Order|Item)\.(find|get|where)\b",
        r"(?i)SELECT\s+.*\s+FROM",
        r"(?i)@GetMapping|@Get|app\.get|router\.get",
        r"(?i)def\s+get_|function\s+get|getUser|getProduct",
        r"(?i)\.findById|\.findOne|\.findAll",
    ]),
    ("update", [
        r"(?i)\b(update|edit|modify|patch|put)\b.*\b(user|product|order|item|entity)\b",
        r"(?i)\b(User|Product|Order|Item)\.update\b",
        r"(?i)UPDATE\s+.*\s+SET",
        r"(?i)@PutMapping|@PatchMapping|@Put|@Patch|app\.put|app\.patch",
        r"(?i)def\s+update_|function\s+update|updateUser|updateProduct",
        r"(?i)\.findByIdAndUpdate|\.updateOne|\.updateMany",
    ]),
    ("delete", [
        r"(?i)\b(delete|remove|destroy)\b.*\b(user|product|order|item|entity)\b",
        r"(?i)\b(User|Product|Order|Item)\.(delete|destroy|remove)\b",
        r"(?i)DELETE\s+FROM",
        r"(?i)@DeleteMapping|@Delete|app\.delete|router\.delete",
        r"(?i)def\s+delete_|function\s+delete|deleteUser|deleteProduct",
        r"(?i)\.findByIdAndDelete|\.deleteOne|\.deleteMany",
    ]),
]
ENTITY_PATTERNS = [
    r"(?i)class\s+(\w+).*\b(entity|model|schema)\b",
    r"(?i)@Entity.*class\s+(\w+)",
    r"(?i)interface\s+(\w+)\s*\{",
    r"(?i)type\s+(\w+)\s*=",
    r"(?i)model\s+(\w+)",
    r"(?i)CREATE\s+TABLE\s+(\w+)",
]
CRUD_EXTENSIONS = ["ts", "js", "java", "py", "rs"]
CRUD_SKIPPED = ["node_modules", "target", ".git"]
ENTITY_NAMES = ["model", "entity", "schema"]
ENTITY_DIRECTORIES = ["/models/", "/entities/"]
LAYERS = [("api", ["controller", "route"]), ("database", ["service", "repository"]), ("frontend", ["component", "page"])]
