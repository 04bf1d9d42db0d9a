# Segment context, fusion weights, grounding terms, repository links.

PURPOSES = [
    ("User management and authentication", ["user", "auth"]),
    ("API service endpoint", ["api", "endpoint"]),
    ("Data persistence and modeling", ["database", "model"]),
    ("Testing and quality assurance", ["test"]),
]
# hundredths
SEGMENT_CONFIDENCE = 50
LARGE_PROJECT = 10000
LAYER_SCORE = {"Presentation": 30, "Business": 40, "Data": 30, "Infrastructure": 20, "Cross": 10}
PRESENTATION_WORDS = ["component", "page", "view"]
ARCHITECTURE_OF = {
    "React": "Component-Based Architecture",
    "NestJS": "Decorator-Based Architecture",
    "SpringBoot": "Dependency Injection",
    "Django": "MTV Pattern",
    "FastAPI": "ASGI Architecture",
}
OTHER_ARCHITECTURE = "Framework-Specific Pattern"
SCALABILITY = {
    "React": "Client-side scalability with component architecture",
    "NextJS": "Client-side scalability with component architecture",
    "NestJS": "Server-side scalability with microservices support",
    "SpringBoot": "Server-side scalability with microservices support",
    "FastAPI": "High-performance async API scalability",
}
# framework -> domain words that add 0.3 each; other frameworks add 0.1 per domain
ALIGNMENT = {
    "React": ["web", "frontend", "ui"],
    "NextJS": ["web", "frontend", "ui"],
    "SpringBoot": ["api", "service", "backend"],
    "NestJS": ["api", "service", "backend"],
    "Flask": ["web", "api", "service"],
    "FastAPI": ["web", "api", "service"],
}
HIGH_VALUE_WORDS = ["payment", "user", "auth", "api", "data", "analytics", "security"]

KEYWORDS = [
    "user", "auth", "login", "register", "product", "order", "cart",
    "payment", "billing", "inventory", "customer", "account", "profile",
    "content", "post", "article", "media", "upload", "publish",
    "analytics", "metrics", "report", "dashboard", "chart", "data",
    "api", "endpoint", "service", "integration", "webhook",
]
# grounded name -> (pattern text, terms, capabilities)
GROUNDS = {
    "E-commerce": ("E-commerce: %s management detected", ["cart", "checkout", "payment", "order", "product", "inventory", "shipping", "billing", "customer", "purchase", "transaction"],
                   ["Product Catalog Management", "Shopping Cart Operations", "Payment Processing", "Order Management"]),
    "User Management": ("Authentication: %s system detected", ["auth", "login", "register", "user", "token", "session", "password", "jwt", "oauth", "permission", "role", "security"],
                        ["User Registration", "Authentication & Authorization", "Profile Management", "Session Management"]),
    "Authentication": ("Authentication: %s system detected", ["auth", "login", "register", "user", "token", "session", "password", "jwt", "oauth", "permission", "role", "security"],
                       ["User Registration", "Authentication & Authorization", "Profile Management", "Session Management"]),
    "Content Management": ("CMS: %s functionality detected", ["content", "post", "article", "page", "blog", "cms", "editor", "publish", "draft", "media", "upload", "gallery"],
                           ["Content Creation & Editing", "Content Publishing", "Media Management", "Content Workflow"]),
    "Analytics": ("Analytics: %s capability detected", ["analytics", "metrics", "tracking", "report", "dashboard", "chart", "graph", "data", "statistics", "kpi", "insight"],
                  ["Data Collection & Processing", "Metrics & KPI Tracking", "Report Generation", "Data Visualization"]),
    "API": ("API: %s pattern detected", ["api", "endpoint", "route", "controller", "service", "integration", "webhook", "rest", "graphql", "microservice", "gateway"],
            ["External System Integration", "Data Synchronization", "Service Orchestration", "API Gateway Operations"]),
}
GROUND_NAMES = {"ECommerce": "E-commerce", "UserManagement": "User Management", "ContentManagement": "Content Management", "ApiGateway": "API"}
BUSINESS_VALUE_STEPS = [(30, ["ecommerce", "payment"]), (20, ["user", "auth"]), (20, ["analytics", "data"])]
STATUS_WEIGHT = {"Complete": 20, "In Progress": 80, "Partial": 60, "Planned": 40}
EFFORTS = {"Complete": "Maintenance", "In Progress": "Medium", "Partial": "High", "Planned": "Very High"}
ROADMAP_VALUES = [(90, ["ecommerce", "payment"]), (80, ["user", "auth"]), (70, ["analytics", "data"]), (60, ["content", "cms"])]

PARENT_PATTERN = r"(?i)\b(?:parent|main|root|master|core)\s+project\b"
OVERVIEW_PATTERN = r"(?i)\b(?:architecture|system\s+design|overview|structure)\b"
ROLES = [
    ("Frontend", ["frontend", "ui", "client"]),
    ("Backend", ["backend", "api", "server"]),
    ("Data Layer", ["database", "data", "storage"]),
    ("Authentication Service", ["auth", "authentication", "security"]),
    ("Gateway Service", ["gateway", "proxy", "load balancer"]),
]
DEFAULT_ROLE = "Component Service"
INFRASTRUCTURE = [
    ("Docker", ["docker", "container"]),
    ("Kubernetes", ["kubernetes", "k8s"]),
    ("Redis", ["redis"]),
    ("PostgreSQL", ["postgresql", "postgres"]),
    ("MongoDB", ["mongodb", "mongo"]),
    ("Nginx", ["nginx"]),
]
