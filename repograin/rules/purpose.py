"""Business purposes by domain, and what a product is for whom."""

# Fixed values that results must equal: patterns by domain, each worth its kind's points.
POINTS = {"endpoint": 2, "dependency": 3, "file": 1}
INDICATORS = {
    "audio_processing": {
        "endpoint": ["/process", "/separate", "/extract", "audio", "midi"],
        "dependency": ["demucs", "basic-pitch", "librosa", "tensorflow", "torch", "audio", "music", "separation"],
        "file": ["separation", "extraction", "midi", "audio", "music"],
    },
    "ecommerce": {
        "endpoint": ["/products", "/cart", "/orders", "/payment", "/checkout"],
        "dependency": ["stripe", "payment", "commerce", "shop"],
        "file": ["product", "order", "payment", "cart"],
    },
    "developer_tools": {
        "endpoint": ["/analyze", "/detect", "/parse", "/extract"],
        "dependency": ["tree-sitter", "ast", "parser", "analyzer", "serde", "cli", "rust", "static", "code", "codebase"],
        "file": ["codebase", "analyzer", "detector", "parser", "ast", "framework", "intelligence", "core", "code_analysis", "static_analysis", "developer_tools"],
    },
}
GENERAL = "general_software"
CONFIDENCE, GENERAL_CONFIDENCE = 0.85, 0.6

# Fixed values: (description, problem, value proposition; None: made from the key features)
STATEMENTS = {
    "audio_processing": (
        "Specialized microservice for music production and collaboration that intelligently separates audio recordings into individual instrument stems and extracts MIDI notation from the separated tracks.",
        "Musicians and producers need to isolate individual instruments from mixed recordings for remixing, collaboration, and detailed audio editing, but traditional audio editing tools require manual and time-consuming separation processes.",
        "Transforms complex audio engineering tasks into simple API calls, enabling musicians and developers to integrate professional-grade audio processing into their workflows without specialized expertise.",
    ),
    "ecommerce": (
        "E-commerce platform that enables online buying and selling of products or services.",
        "Businesses need an efficient way to sell products online and customers need a reliable platform to discover and purchase items with secure payment processing.",
        "Provides a complete online selling solution with secure payments, inventory management, and customer experience optimization.",
    ),
    "developer_tools": (
        "Advanced reverse engineering and codebase analysis tool that transforms existing codebases into systematic development workflows, generating PRDs, user stories, and task breakdowns with AI-powered business domain inference.",
        "Development teams need to understand and reverse-engineer existing codebases to continue development, but manual code analysis is time-consuming and often misses critical business context and architectural patterns.",
        None,
    ),
    GENERAL: (
        "Software application providing specialized functionality through a web-based interface.",
        "Users need an efficient solution to accomplish their specific domain tasks through a reliable and user-friendly interface.",
        None,
    ),
}
VALUE = "Delivers %s through an intuitive interface designed for efficiency and reliability."

# Key features by a word of an endpoint, then by a word of the README
ENDPOINT_FEATURES = [
    ("/process", "Asynchronous processing of user submissions"),
    ("/status", "Real-time job status tracking"),
    ("/download", "Downloadable processed results"),
]
README_FEATURES = [
    ("separation", "Audio source separation into individual stems"),
    ("midi", "MIDI extraction from audio recordings"),
    ("api", "RESTful API for programmatic access"),
]
NO_FEATURE = "Core functionality as determined by system design"

# Who uses it and what for
USERS = {
    "audio_processing": ["Music producers and sound engineers", "Musicians and composers", "Music collaboration platforms", "Audio content creators"],
    "ecommerce": ["Online shoppers", "Merchants and retailers", "E-commerce administrators"],
    "developer_tools": ["Software developers and engineers", "Development teams and tech leads", "Project managers and product owners", "Code auditors and consultants"],
}
SCENARIOS = {
    "audio_processing": [
        "Music producer uploads a mixed track to extract individual instruments for remixing",
        "Collaborative music platform automatically processes user uploads for multi-user editing",
        "Musician extracts MIDI from audio recordings for notation and arrangement work",
        "Audio engineer isolates vocal tracks for cleaning and enhancement",
    ],
    GENERAL: [
        "User accesses the system through the web interface",
        "Developer integrates with the system using API endpoints",
        "Administrator manages system configuration and monitoring",
    ],
}
INDICATORS_OF_SUCCESS = {
    "audio_processing": [
        "High-quality stem separation with minimal artifacts",
        "Fast processing times for user uploads",
        "Accurate MIDI extraction from audio sources",
        "High user satisfaction with separation quality",
        "Successful API integration by platform developers",
    ],
    GENERAL: ["User engagement and retention", "System performance and reliability", "Feature adoption rates"],
}
# Fixed values: (name, role, goals, pain points)
PERSONAS = {
    "audio_processing": [
        ("Music Producer", "Professional music producer",
         ["Quickly isolate instruments for remixing", "Create clean stems for collaboration", "Analyze musical arrangements"],
         ["Manual audio separation is time-consuming", "Existing tools require specialized knowledge", "Quality varies between different separation methods"]),
        ("Platform Developer", "Developer building music collaboration tools",
         ["Integrate audio processing into their platform", "Provide seamless user experience", "Scale processing for multiple users"],
         ["Complex audio processing requires specialized expertise", "Infrastructure for audio processing is expensive", "Need reliable API for consistent results"]),
    ],
    GENERAL: [("End User", "Primary system user", ["Accomplish tasks efficiently"], ["Current solutions are inadequate"])],
}

# Fixed values of a product by the domain of its controllers and services:
# (product type, business domain, confidence, personas, journeys); %s is the framework
PRODUCTS = {
    "UserManagement": (
        "%s User Authentication & Management Service", "User Management", 0.95,
        ["End User", "System Administrator", "Client Application", "Frontend Developer"],
        ["User registers for new account and verifies email", "User logs in using credentials and receives authentication token", "User manages profile information and account settings",
         "Administrator manages user accounts and permissions", "Client application authenticates users and manages sessions"],
    ),
    "Authentication": (
        "%s Authentication Service", "Authentication", 0.9,
        ["End User", "Client Application", "System Administrator"],
        ["User authenticates using credentials to access protected resources", "Client application obtains and refreshes authentication tokens",
         "Administrator manages authentication policies and security settings"],
    ),
    "RealEstate": (
        "%s Real Estate Property Management System", "Real Estate", 0.9,
        ["Property Buyer/Renter", "Property Owner/Seller", "Real Estate Agent", "Property Manager"],
        ["Property Buyer searches for properties by location, price, and features", "Property Owner lists their property with photos and details",
         "Real Estate Agent manages property listings and client inquiries", "Property Manager tracks property status and maintenance"],
    ),
    "Ecommerce": (
        "E-commerce Platform", "E-commerce", 0.85,
        ["Customer", "Store Owner", "Admin"],
        ["Customer browses products and makes purchases", "Store owner manages inventory and orders"],
    ),
    "API": (
        "%s REST API Service", "API Service", 0.7,
        ["API Client", "Frontend Application", "Mobile App", "System Administrator"],
        ["Client applications consume REST API endpoints for data operations", "Third-party integrations access business data via API",
         "Administrators monitor API performance and manage system health"],
    ),
    "Generic": ("Web Application", "Generic", 0.6, ["End User"], ["User interacts with the application interface"]),
}
API_LEAST = 2  # a product is an API service with more controllers than this
API_NAMES = ["controller", "service", "repository"]
