# Hints, routes, components, complexity weights, stories.

SEGMENT_LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "java": "java"}
# language -> (kind, pattern with indent as group 1, group of the name)
DECLARATIONS = {
    "python": [
        ("Class", r"^(\s*)class\s+(\w+)", 2),
        ("Function", r"^(\s*)(?:async\s+)?def\s+(\w+)", 2),
    ],
    "typescript": [
        ("Class", r"^(\s*)(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", 2),
        ("Interface", r"^(\s*)(?:export\s+)?interface\s+(\w+)", 2),
        ("Function", r"^(\s*)(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)", 2),
        ("Function", r"^(\s*)(?:export\s+)?const\s+(\w+)[^=]*=\s*(?:async\s*)?\([^)]*\)\s*=>", 2),
        ("Function", r"^(\s+)(?:(?:public|private|protected|static|async)\s+)*(\w+)\s*\([^)]*\)\s*(?::\s*[^{]+)?\{\s*$", 2),
    ],
    "java": [
        ("Class", r"^(\s*)(?:(?:public|private|protected|abstract|final|static)\s+)*class\s+(\w+)", 2),
        ("Interface", r"^(\s*)(?:(?:public|private|protected)\s+)*interface\s+(\w+)", 2),
        ("Function", r"^(\s*)(?:(?:public|private|protected|static|final)\s+)+[\w<>\[\], ]+\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+[\w, ]+)?\{", 2),
    ],
}
NOT_NAMES = ["if", "for", "while", "switch", "catch", "return", "function"]

HINTS = {
    "typescript": [
        ("Authentication", ["auth", "login", "password"]),
        ("User Management", ["user", "profile", "account"]),
        ("Notification", ["notification", "email", "sms"]),
        ("Payment", ["payment", "billing", "subscription"]),
        ("Analytics", ["analytics", "tracking", "metrics"]),
    ],
    "python": [
        ("Authentication", ["auth", "login", "password", "jwt", "token"]),
        ("User Management", ["user", "profile", "account", "permission", "role"]),
        ("Notification", ["notification", "email", "sms", "alert", "message"]),
        ("Payment", ["payment", "billing", "subscription", "invoice", "charge"]),
        ("Analytics", ["analytics", "tracking", "metrics", "report", "dashboard"]),
        ("E-commerce", ["product", "order", "cart", "inventory", "catalog"]),
    ],
    "java": [
        ("Authentication", ["auth", "login", "password", "jwt", "token", "security"]),
        ("User Management", ["user", "profile", "account", "permission", "role"]),
        ("Notification", ["notification", "email", "sms", "alert", "message"]),
        ("Payment", ["payment", "billing", "subscription", "invoice", "charge", "transaction"]),
        ("Analytics", ["analytics", "tracking", "metrics", "report", "dashboard", "audit"]),
        ("E-commerce", ["product", "order", "cart", "inventory", "catalog"]),
    ],
}
MODEL_WORDS = {
    "python": ["db.Model", "Base", "declarative_base", "Column", "relationship", "models.Model", "models.CharField", "models.IntegerField", "BaseModel", "Field("],
    "java": ["@Entity", "@Table", "@Id", "@Column", "@JoinColumn", "@ManyToOne", "@OneToMany", "@ManyToMany"],
}
PY_FIELD_WORDS = ["Column(", "models.", "Field("]
PY_RELATION_WORDS = ["relationship(", "ForeignKey("]
JAVA_RELATION_WORDS = ["@OneToMany", "@ManyToOne", "@ManyToMany", "@OneToOne"]
# Detected framework -> (path words, content words); in order of detection.
SEGMENT_FRAMEWORKS = [
    ("Flask", [], ["@app.route", "flask"]),
    ("FastAPI", [], ["@app.get", "fastapi"]),
    ("React", ["component"], ["usestate", "useeffect", "jsx"]),
    ("NestJS", [], ["@controller", "@injectable", "@module"]),
    ("SpringBoot", [], ["@restcontroller", "@service", "@component"]),
]

COMPLEXITY_BASE = 10
COMPLEXITY = {
    "typescript": [("if ", 2), ("for ", 3), ("while ", 3), ("switch ", 4), ("try ", 2), ("useState", 1), ("useEffect", 2), ("function", 1), ("=>", 1)],
    "python": [("if ", 2), ("for ", 3), ("while ", 3), ("try:", 2), ("except ", 2), ("def ", 1), ("class ", 2)],
    "java": [("if ", 2), ("for ", 3), ("while ", 3), ("switch ", 4), ("try ", 2), ("catch ", 2), ("@", 1)],
}
HOOKS = ["useState", "useEffect", "useContext", "useReducer", "useCallback", "useMemo", "useRef"]
PURPOSES = {
    "Page": "Renders the %s page interface",
    "Layout": "Provides layout structure for %s",
    "Form": "Handles form interactions for %s",
    "Navigation": "Provides navigation functionality for %s",
    "Modal": "Displays modal dialog for %s",
    "Hook": "Custom hook providing %s functionality",
    "Context": "Context provider for %s state management",
    "Service": "Service layer for %s operations",
    "Display": "Displays %s information",
    "Utility": "Utility functions for %s",
}
TS_FETCH = r"""fetch\s*\(\s*['"`]([^'"`]+)['"`]"""
TS_AXIOS = r"""axios\.(\w+)\s*\(\s*['"`]([^'"`]+)['"`]"""
TS_IMPORT = r"""import\s+.*?\s+from\s+['"`]([^'"`]+)['"`]"""
PY_ROUTE = r"""@app\.route\s*\(\s*["']([^"']+)["']"""
PY_PATH = r"""path\s*\(\s*r?["']([^"']+)["']"""
PY_IMPORT = r"(?:from\s+([a-zA-Z0-9_.]+)\s+import|import\s+([a-zA-Z0-9_.]+))"
JAVA_MAPPING = r'@(?:Get|Post|Put|Delete)Mapping\s*\(\s*"([^"]+)"'
JAVA_IMPORT = r"import\s+([a-zA-Z0-9_.]+)"
TS_PROPS = r"interface\s+(\w+Props)\s*\{([^}]+)\}"
TS_ARGUMENTS = r"function\s+\w+\s*\(\s*\{\s*([^}]+)\s*\}"
PY_ARGUMENT = r"def\s+\w+\s*\([^)]*(\w+):\s*(\w+)"

STORY_GROUPS = [
    ("User", ["user", "auth", "session", "jwt"], ["/user/", "/auth/"]),
    ("Property", ["property"], ["/property/"]),
    ("Location", ["location"], ["/location/"]),
    ("Image", ["image"], ["/image/"]),
    ("API", ["controller", "service", "repository", "middleware"], []),
]
# (group, title, priority, complexity, criteria)
STORIES = [
    ("User", "User authentication and registration", "Critical", "Complex", [
        "User can register with email and secure password",
        "User receives email verification for account activation",
        "User can log in with valid credentials and receive authentication token",
        "Failed login attempts are handled securely with appropriate error messages",
        "User can reset password through secure email process",
    ]),
    ("User", "Manage user profile and account settings", "High", "Medium", [
        "User can view and update personal information (name, email, etc.)",
        "User can change password with current password verification",
        "User can manage account preferences and settings",
        "Profile updates are validated and saved securely",
        "User can delete account with proper confirmation process",
    ]),
    ("User", "Secure session and token management", "High", "Complex", [
        "JWT tokens are issued upon successful authentication",
        "Token refresh mechanism handles expired tokens automatically",
        "Session state is maintained securely across requests",
        "User can log out and invalidate sessions properly",
        "Concurrent sessions are handled according to security policies",
    ]),
    ("Property", "Manage real estate property listings", "Critical", "Complex", [
        "Property manager can create new property listings with all required details",
        "Property information can be updated (price, status, description, features)",
        "Property status can be managed (available, sold, rented, under contract)",
        "Property listings include comprehensive details (area, location, amenities)",
        "Data validation ensures property information integrity",
    ]),
    ("Property", "Search and filter properties", "High", "Medium", [
        "Users can search properties by location, price range, and property type",
        "Advanced filters available (area size, number of rooms, amenities)",
        "Search results display key property information and images",
        "Search performance is optimized for large property inventories",
        "Users can save search criteria and receive notifications for new matches",
    ]),
    ("Location", "Manage property location data", "High", "Medium", [
        "Property locations include detailed address information",
        "Geographic coordinates support map-based property display",
        "Location data supports proximity-based searches",
        "Address validation ensures data accuracy",
        "Integration with mapping services for enhanced user experience",
    ]),
    ("Image", "Manage property images and media", "High", "Medium", [
        "Multiple images can be uploaded for each property",
        "Images are optimized for web display and mobile viewing",
        "Image metadata includes descriptions and categorization",
        "Primary/featured image can be designated for listings",
        "Image management supports reordering and deletion",
    ]),
    ("API", "Provide comprehensive REST API service", "High", "Complex", [
        "RESTful endpoints follow standard HTTP methods and status codes",
    ]),
]
# sentences of the stories above, in their order
STORY_SENTENCES = [
    "As an end user, I want to register for an account and authenticate securely so that I can access protected features and maintain my personal data",
    "As an authenticated user, I want to manage my profile information and account settings so that I can keep my data current and customize my experience",
    "As a client application, I want secure session and token management so that I can maintain user authentication state and handle token refresh seamlessly",
    "As a property manager, I want to create, update, and manage property listings so that I can efficiently handle real estate inventory and provide accurate information to potential buyers or renters",
    "As a property seeker (buyer/renter), I want to search for properties using various criteria so that I can find properties that match my specific needs and preferences",
    "As a system user, I want accurate geographic and address information for properties so that I can provide location-based services and help users find properties in desired areas",
    "As a property manager, I want to upload, organize, and display high-quality images of properties so that potential buyers/renters can get a comprehensive visual understanding of the property",
    "As an API consumer (frontend application, mobile app, or third-party service), I want access to a reliable REST API so that I can integrate with the system's data and functionality",
]
PYTHON_SERVICE_SENTENCE = "As a user, I want to access %s service functionality"
JAVA_SERVICE_SENTENCE = "As a user, I want to use %s service functionality"
DISPLAY_SENTENCE = "As a user, I want to interact with %s interface"
PLAIN_SENTENCE = "As a system user, I want to access %s capabilities so that I can %s"
SERVICE_CRITERIA = ["%s service responds correctly", "Service handles errors gracefully", "Service provides expected functionality"]
DISPLAY_CRITERIA = ["%s displays correctly", "Interface is responsive and user-friendly", "All interactive elements work as expected"]

FEATURES = {
    "Page": ("Page Navigation", "Users can access different sections of the application efficiently"),
    "Form": ("Data Input Forms", "Users can input and submit data through validated forms"),
    "Layout": ("Application Layout", "Users experience consistent navigation and visual structure"),
}
CONFIG_FILES = {
    "package.json": "NPM Configuration",
    "next.config.js": "Next.js Configuration",
    ".env": "Environment Variables",
    ".env.local": "Local Environment Variables",
    "tsconfig.json": "TypeScript Configuration",
    "tailwind.config.js": "Tailwind CSS Configuration",
}
