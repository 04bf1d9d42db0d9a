# Business domain rules, candidates, configuration, project types.

PYTHON, FLASK, FASTAPI, NEST = "python", "flask", "fastapi", "nest"
# A pack runs once per detected framework it lists.
PACK_FRAMEWORKS = {PYTHON: ["Flask", "FastAPI"], FLASK: ["Flask"], FASTAPI: ["FastAPI"], NEST: ["NestJS"]}
# (pack, domain, weight, extension, path scope words, any-of content words, any-of path words); one row per file.
ANY_OF = [
    (FLASK, "Authentication", 40, "py", [], ["@app.route('/auth/login')", "@bp.route('/login')", "@auth_bp.route(", "/auth/"], []),
    (FLASK, "UserManagement", 30, "py", [], ["/users", "/user/", "/profile"], []),
    (FLASK, "ECommerce", 35, "py", [], ["/products", "/cart", "/orders", "/checkout", "/payment"], []),
    (FASTAPI, "Authentication", 40, "py", [], ['@router.post("/auth/login")', '@router.post("/login")', "/auth/", "@auth_router"], []),
    (FASTAPI, "UserManagement", 30, "py", [], ["/users", "/user/", "/profile"], []),
    (FASTAPI, "ECommerce", 35, "py", [], ["/products", "/cart", "/orders"], []),
    (PYTHON, "Authentication", 30, "py", [], ["class AuthService", "class AuthenticationService"], []),
    (PYTHON, "UserManagement", 30, "py", [], ["class UserService", "class UserManager"], []),
    (PYTHON, "ECommerce", 30, "py", [], ["class ProductService", "class OrderService", "class PaymentService"], []),
    (PYTHON, "Authentication", 25, "py", [], ["from flask_login import", "import jwt", "from passlib", "import bcrypt", "from fastapi.security"], []),
    (PYTHON, "PaymentProcessing", 30, "py", [], ["import stripe", "import paypal", "from payment"], []),
    (PYTHON, "FileManagement", 40, "py", [], ["def upload_file", "def download_file", "def process_file", "import boto3"], []),
    (PYTHON, "Notification", 35, "py", [], ["def send_email", "def send_notification", "def send_sms", "import sendgrid"], []),
    (PYTHON, "DataProcessing", 40, "py", [], ["import pandas", "import numpy", "def process_data", "def transform_data"], []),
    (NEST, "Authentication", 40, "ts", ["controller"], ["@Controller('auth')", "@Controller('/auth')"], ["auth"]),
    (NEST, "UserManagement", 35, "ts", ["controller"], ["@Controller('users')", "@Controller('/users')", "@Controller('user')"], ["user"]),
    (NEST, "Notification", 40, "ts", ["controller"], ["@Controller('notifications')", "@Controller('/notifications')", "@Controller('notification')"], ["notification"]),
    (NEST, "Authentication", 30, "ts", ["service"], ["class AuthService", "class AuthenticationService"], ["auth"]),
    (NEST, "UserManagement", 30, "ts", ["service"], ["class UserService", "class UserManagementService"], ["user"]),
    (NEST, "Notification", 35, "ts", ["service"], ["class NotificationService", "class NotificationsService"], ["notification"]),
    (NEST, "Authentication", 30, "ts", ["usecase"], [], ["auth"]),
    (NEST, "UserManagement", 30, "ts", ["usecase"], [], ["user"]),
    (NEST, "ApiGateway", 40, "ts", [], ["@ApiGatewayTimeoutResponse", "@ApiResponse", "@ApiBearerAuth", "@ApiOperation"], []),
    (NEST, "Authentication", 35, "ts", [], ["@UseGuards(AuthGuard", "@UseGuards(JwtAuthGuard", "class AuthGuard", "class JwtAuthGuard"], []),
    (NEST, "UserManagement", 40, "ts", [], ["@UseGuards(RolesGuard", "@Roles(", "class RolesGuard", "@UseGuards(PermissionGuard"], []),
    (NEST, "DataProcessing", 25, "ts", [], ["ValidationPipe", "@UsePipes(ValidationPipe)", "ParseIntPipe", "ParseUUIDPipe"], []),
    (NEST, "Authentication", 35, "ts", ["dto"], [], ["login", "register", "auth", "token"]),
    (NEST, "ECommerce", 40, "ts", ["dto"], [], ["create-order", "payment", "product", "cart"]),
    (NEST, "UserManagement", 40, "ts", ["dto"], [], ["create-user", "update-user", "user", "profile"]),
    (NEST, "DataProcessing", 25, "ts", ["dto"], ["@IsString()", "@IsEmail()", "@IsNumber()", "@ValidateNested()"], []),
]
# (pack, domain, weight, extension, path scope words, words); one row per word and file.
EACH_OF = [
    (PYTHON, "Authentication", 35, "py", [], ["def login", "def logout", "def authenticate", "def verify_token", "def hash_password", "def check_password", "def generate_token", "def validate_user", "def verify_credentials"]),
    (PYTHON, "UserManagement", 40, "py", [], ["def create_user", "def get_user", "def update_user", "def delete_user", "def get_users", "def update_profile", "def get_profile", "def activate_user", "def deactivate_user"]),
    (PYTHON, "ECommerce", 45, "py", [], ["def create_order", "def process_payment", "def add_to_cart", "def checkout", "def calculate_total", "def apply_discount", "def process_refund", "def update_inventory", "def get_products"]),
    (PYTHON, "Analytics", 40, "py", [], ["def track_event", "def analyze_data", "def generate_report", "def calculate_metrics", "def process_analytics", "def aggregate_data", "def create_dashboard"]),
    (PYTHON, "UserManagement", 50, "py", ["models", "schema"], ["class User", "class Profile", "class Account", "class Role", "class Permission"]),
    (PYTHON, "ECommerce", 50, "py", ["models", "schema"], ["class Product", "class Order", "class Cart", "class Payment", "class Invoice", "class Category"]),
    (PYTHON, "ContentManagement", 45, "py", ["models", "schema"], ["class Article", "class Post", "class Page", "class Content", "class Media", "class Tag"]),
    (PYTHON, "Authentication", 30, "py", [], ["@login_required", "@jwt_required", "@token_required", "require_auth", "check_permission", "verify_token", "validate_session"]),
    (NEST, "ECommerce", 45, "ts", [], ["@Get('products')", "@Post('orders')", "@Get('cart')", "@Post('payment')", "@Get('orders')", "@Post('checkout')", "@Get('inventory')", "@Post('products')"]),
    (NEST, "ContentManagement", 40, "ts", [], ["@Get('articles')", "@Post('articles')", "@Get('posts')", "@Post('posts')", "@Get('pages')", "@Post('media')", "@Get('content')"]),
]
# Entity files: first group whose words the file stem holds.
NEST_ENTITIES = [
    ("UserManagement", 50, ["user", "account", "profile"]),
    ("ECommerce", 50, ["product", "order", "payment", "cart"]),
    ("ContentManagement", 45, ["article", "post", "content", "media"]),
    ("Notification", 40, ["notification", "message"]),
]
NOTIFICATION_USECASES = ["markAsRead", "markAllAsRead", "getAllNotifications", "markAsDeleted", "send", "create"]
# (pack, domain, weight, directories); one row per project.
DIRECTORIES = [
    (PYTHON, "Authentication", 20, ["auth", "authentication", "src/auth"]),
    (PYTHON, "UserManagement", 20, ["users", "user", "src/users"]),
    (PYTHON, "ECommerce", 20, ["products", "orders", "payments", "cart"]),
    (NEST, "Authentication", 20, ["src/auth", "src/authentication"]),
    (NEST, "UserManagement", 20, ["src/users", "src/user"]),
    (NEST, "Notification", 25, ["src/notifications", "src/notification"]),
]
KEEP, PRIMARY = 40, 60
STRATEGIES = [(80, "Comprehensive"), (60, "Core")]

BUSINESS_TYPES = [
    ("Analytics Tool", ["analyzer", "analysis"], ["analyze", "analysis"]),
    ("Authentication Service", ["auth"], ["auth", "login", "security"]),
    ("E-commerce Platform", ["shop", "commerce"], ["ecommerce", "store"]),
    ("Content Management System", ["cms", "content"], ["blog", "article"]),
]
WEB_FRAMEWORKS = ["React", "NextJS"]
API_FRAMEWORKS = ["SpringBoot", "NestJS", "FastAPI", "Flask"]
CANDIDATES = {
    "Analytics Tool": ["Analytics", "DataProcessing"],
    "Authentication Service": ["Authentication", "UserManagement"],
    "E-commerce Platform": ["ECommerce", "Payment", "UserManagement"],
    "Content Management System": ["ContentManagement", "UserManagement"],
    "Web Application": ["UserManagement", "ContentManagement"],
    "API Service": ["DataProcessing", "Integration"],
    "Application": ["Unknown"],
}
# (candidate, weight, words, pattern text)
SEMANTICS = [
    ("Analytics", 50, ["analyze", "analysis", "metrics"], "Analytics keywords found"),
    ("Analytics", 45, ["report", "dashboard", "statistics"], "Reporting functionality detected"),
    ("Authentication", 55, ["login", "logout", "authenticate"], "Authentication methods found"),
    ("Authentication", 50, ["password", "token", "jwt"], "Security tokens and credentials"),
    ("ECommerce", 60, ["order", "cart", "checkout"], "E-commerce order management"),
    ("ECommerce", 55, ["payment", "price", "product"], "Product and payment processing"),
    ("UserManagement", 50, ["user", "profile", "account"], "User management entities"),
    ("DataProcessing", 50, ["process", "transform", "parse"], "Data processing operations"),
]
PATTERN_DOMAINS = [
    ("Analytics", ["analytics", "analysis"]),
    ("Authentication", ["auth", "security"]),
    ("ECommerce", ["ecommerce", "order"]),
    ("UserManagement", ["user"]),
    ("DataProcessing", ["data", "process"]),
]
LABELS = [
    ("Authentication", ["auth", "login", "security"]),
    ("UserManagement", ["user", "profile", "account"]),
    ("ECommerce", ["commerce", "shop", "product", "cart"]),
    ("ContentManagement", ["content", "cms", "blog", "article"]),
    ("Analytics", ["analytic", "metric", "report", "dashboard"]),
    ("ApiGateway", ["api", "gateway", "proxy"]),
    ("DataProcessing", ["data", "process", "etl", "pipeline"]),
    ("Notification", ["notification", "message", "email", "sms"]),
    ("FileManagement", ["file", "upload", "storage", "document"]),
    ("PaymentProcessing", ["payment", "billing", "invoice", "subscription"]),
    ("Analytics", ["codebase", "analysis", "intelligence", "workflow"]),
]
RANK_WEIGHTS = {1: 6, 2: 3, 3: 1}
# project type -> (raised domains, lowered domains); hundredths +15 / -20
ADJUSTMENTS = {
    "analysis_tool": (["Analytics", "DataProcessing"], ["UserManagement", "ECommerce", "ContentManagement"]),
    "web_application": (["UserManagement", "Authentication"], []),
    "api_service": (["ApiGateway", "DataProcessing"], []),
}

# id -> (name, description, keywords, [(pattern type, patterns, weight in hundredths)])
CONFIG = {
    "authentication": ("Authentication", "Login, signup, password management, OAuth integration", ["auth", "login", "signup", "password", "oauth", "jwt", "token", "session"], [
        ("route_pattern", ["/auth", "/login", "/signup", "/logout", "/oauth"], 90), ("file_pattern", ["auth", "login", "signup", "oauth", "jwt"], 80)]),
    "user_management": ("User Management", "User profiles, permissions, roles, account settings", ["user", "profile", "account", "role", "permission", "settings"], [
        ("route_pattern", ["/users", "/profile", "/account", "/settings"], 90), ("database_pattern", ["User", "Profile", "Account", "Role", "Permission"], 80), ("component_pattern", ["UserProfile", "AccountSettings", "RoleManager"], 70)]),
    "payment_processing": ("Payment Processing", "Billing, subscriptions, transactions, invoicing", ["payment", "billing", "subscription", "invoice", "transaction", "stripe", "paypal"], [
        ("route_pattern", ["/payment", "/billing", "/subscription", "/checkout"], 90), ("service_integration", ["stripe", "paypal", "square", "braintree"], 85), ("database_pattern", ["Payment", "Invoice", "Subscription", "Transaction"], 80)]),
    "ecommerce": ("E-commerce", "Product catalogs, shopping carts, order processing", ["product", "cart", "order", "catalog", "inventory", "shop"], [
        ("route_pattern", ["/products", "/cart", "/orders", "/checkout", "/shop"], 90), ("database_pattern", ["Product", "Cart", "Order", "Inventory"], 80), ("component_pattern", ["ProductList", "ShoppingCart", "OrderSummary"], 70)]),
    "content_management": ("Content Management", "CRUD operations, media handling, publishing workflows", ["content", "cms", "post", "article", "media", "publish", "editor"], [
        ("route_pattern", ["/content", "/posts", "/articles", "/media", "/admin"], 90), ("database_pattern", ["Post", "Article", "Content", "Media", "Category"], 80), ("crud_pattern", ["create", "read", "update", "delete", "publish"], 70)]),
    "analytics": ("Analytics", "Event tracking, reporting, metrics collection, dashboards", ["analytics", "tracking", "metrics", "dashboard", "report", "stats"], [
        ("route_pattern", ["/analytics", "/dashboard", "/metrics", "/reports"], 90), ("service_integration", ["google-analytics", "segment", "mixpanel", "amplitude"], 80), ("method_pattern", ["track", "measure", "analyze", "report"], 70)]),
    "notification_system": ("Notification System", "Email, SMS, push notifications, alert management", ["notification", "email", "sms", "push", "alert", "message"], [
        ("service_integration", ["sendgrid", "mailgun", "twilio", "firebase-messaging"], 90), ("database_pattern", ["Notification", "Message", "Alert", "EmailTemplate"], 80), ("method_pattern", ["sendEmail", "sendSMS", "pushNotification"], 70)]),
    "communication": ("Communication", "Chat systems, messaging, comments, social features", ["chat", "message", "comment", "social", "forum", "discussion"], [
        ("route_pattern", ["/chat", "/messages", "/comments", "/forum"], 90), ("websocket_pattern", ["websocket", "socket.io", "realtime", "chat"], 80), ("database_pattern", ["Message", "Chat", "Comment", "Conversation"], 70)]),
    "api_gateway": ("API Gateway", "API routing, rate limiting, authentication middleware", ["gateway", "proxy", "routing", "middleware", "rate-limiting"], [
        ("infrastructure_pattern", ["gateway", "proxy", "router", "middleware"], 90), ("rate_limiting_pattern", ["rate-limit", "throttle", "quota"], 80)]),
    "file_management": ("File Management", "File upload, storage, processing, CDN integration", ["file", "upload", "storage", "cdn", "asset", "media"], [
        ("route_pattern", ["/upload", "/files", "/assets", "/media"], 90), ("service_integration", ["aws-s3", "cloudinary", "azure-storage"], 80), ("method_pattern", ["upload", "download", "store", "process"], 70)]),
    "data_processing": ("Data Processing", "ETL operations, data transformation, batch processing", ["etl", "transform", "process", "batch", "pipeline", "data"], [
        ("pipeline_pattern", ["pipeline", "etl", "transform", "batch"], 90), ("data_framework", ["pandas", "spark", "kafka", "airflow"], 80)]),
    "search_functionality": ("Search Functionality", "Full-text search, filtering, indexing", ["search", "filter", "index", "query", "elasticsearch", "solr"], [
        ("route_pattern", ["/search", "/filter"], 90), ("search_engine", ["elasticsearch", "solr", "algolia"], 80)]),
    "workflow_automation": ("Workflow Automation", "Business process automation, workflow management", ["workflow", "automation", "process", "task", "job", "scheduler"], [
        ("workflow_pattern", ["workflow", "process", "task", "job"], 90), ("scheduler_pattern", ["cron", "scheduler", "queue", "worker"], 80)]),
    "monitoring_observability": ("Monitoring & Observability", "Application monitoring, logging, performance tracking", ["monitoring", "logging", "metrics", "tracing", "observability"], [
        ("monitoring_tool", ["prometheus", "grafana", "datadog", "newrelic"], 90), ("logging_pattern", ["logger", "log", "trace", "metric"], 80)]),
    "codebase_intelligence": ("Codebase Intelligence", "Code analysis, static analysis, developer tools", ["analyze", "lint", "format", "parse", "ast", "code-intelligence"], [
        ("analysis_pattern", ["analyze", "parse", "lint", "format", "detect"], 90), ("ast_pattern", ["ast", "tree-sitter", "parser", "syntax"], 80), ("tool_pattern", ["analyzer", "linter", "formatter", "checker"], 80)]),
}
# pattern type -> item kinds it looks at
ITEM_KINDS = {
    "route_pattern": ["endpoint"],
    **{k: ["file"] for k in ["file_pattern", "component_pattern", "database_pattern", "analysis_pattern", "ast_pattern", "tool_pattern"]},
    **{k: ["dependency"] for k in ["service_integration", "data_framework", "search_engine", "monitoring_tool"]},
    **{k: ["endpoint", "file", "dependency"] for k in ["crud_pattern", "method_pattern", "websocket_pattern", "infrastructure_pattern", "rate_limiting_pattern", "pipeline_pattern", "workflow_pattern", "scheduler_pattern", "logging_pattern"]},
}
GENERAL = ("general_software", "General Software", "General purpose software application")

PROJECT_TYPES = {
    "analysis_tool": ("Analysis Tool", "tool capabilities and analysis features", ["Code Analysis", "Developer Tools", "Static Analysis"]),
    "web_application": ("Web Application", "user-facing features and business logic", ["User Interface", "Business Logic", "Web Services"]),
    "api_service": ("API Service", "API endpoints and data processing", ["API Design", "Data Processing", "Backend Services"]),
    "cli_tool": ("CLI Tool", "command-line interface and automation capabilities", ["Automation", "Command Line", "System Tools"]),
    "library": ("Library", "provided abstractions and APIs", ["Code Reusability", "API Design", "Software Architecture"]),
    "unknown": ("Unknown", "general functionality and architecture", []),
}
NAME_PATTERNS = ["analyzer", "linter", "formatter", "checker", "parser"]
ANALYSIS_DEPS = ["tree-sitter", "syn", "swc", "eslint", "ast"]
ANALYSIS_CLI = ["clap", "structopt", "main.rs"]
ANALYSIS_README = ["analyze", "lint", "format", "parse", "static analysis", "code intelligence"]
WEB_DEPS = ["react", "vue", "angular", "next", "nuxt", "express", "koa"]
HEURISTIC_WEB = ["react", "vue", "angular", "next", "nuxt", "express", "koa", "django", "flask", "fastapi"]
HEURISTIC_CLI = ["clap", "structopt", "click", "argparse", "commander"]
# (package manager or *, path, type, hundredths)
ENTRY_POINTS = [
    ("Cargo", "src/main.rs", "Main", 95), ("Cargo", "src/lib.rs", "Module", 90),
    ("Npm", "index.js", "Main", 80), ("Npm", "index.ts", "Main", 80), ("Npm", "src/index.ts", "Main", 85), ("Npm", "src/main.ts", "Main", 85),
    ("Npm", "server.js", "Server", 70), ("Npm", "app.js", "Application", 70),
    ("Deno", "mod.ts", "Module", 90), ("Deno", "main.ts", "Main", 85),
    ("Pip", "main.py", "Main", 80), ("Pip", "app.py", "Application", 70), ("Pip", "__init__.py", "Module", 60),
    ("Unknown", "index.js", "Main", 50), ("Unknown", "index.ts", "Main", 50), ("Unknown", "main.js", "Main", 50), ("Unknown", "main.ts", "Main", 50), ("Unknown", "main.py", "Main", 50),
    ("Unknown", "app.js", "Main", 50), ("Unknown", "app.py", "Main", 50), ("Unknown", "server.js", "Main", 50), ("Unknown", "main.rs", "Main", 50), ("Unknown", "lib.rs", "Main", 50),
]
