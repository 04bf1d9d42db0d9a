"""Framework rule packs as data.

A test is a formula over probes: ``("words", extensions, words)`` some file of
the kind holds one of the words, ``("in", path, words)`` one named file does,
``("file", names)`` and ``("dir", names)`` something exists, combined with
``("any", …)``, ``("all", …)`` and ``("not", x)``.
"""

# Evidence rules of each framework; weights in hundredths.

PY, JS, TS, JAVA = ("py",), ("js", "jsx", "ts", "tsx"), ("ts", "tsx"), ("java",)


def words(exts, *ws):
    return ("words", tuple(exts), ws)


def pruned(exts, *ws):
    """Like ``words`` but outside the ignored directories."""
    return ("pruned", tuple(exts), ws)


def inside(path, *ws):
    return ("in", path, ws)


def file(*names):
    return ("file", names)


def folder(*names):
    return ("dir", names)


URL_IMPORTS = words(("ts", "js"), "https://deno.land/")
IS_DENO = ("any", file("deno.json", "deno.jsonc"), URL_IMPORTS, file("deno.lock"))
DANET_IMPORTS = words(TS, "jsr:@danet/core", "jsr:@danet/cli", "https://deno.land/x/danet", "@danet/core", 'from "@danet/', "from 'jsr:@danet/")
DANET_DECORATORS = ("all", words(TS, "@Controller", "@Injectable", "@Module", "@Get", "@Post", "@Put", "@Delete", "@Patch"), DANET_IMPORTS)
DANET_STRUCTURE = ("all", folder("src/controllers", "src/modules", "src/services", "controllers", "modules", "services"), IS_DENO)
JSX_CONTENT = ("any", ("ext", ("jsx", "tsx")), words(("js", "ts"), "React.createElement", "<div", "<span", "useState", "useEffect"))
NEXT_PATTERNS = words(JS, "getServerSideProps", "getStaticProps", "'use client'", "'use server'", "next/router", "next/navigation")
NEXT_HINTS = ("any", file("next.config.js"), words(("js", "ts"), "next/", "import { NextPage"))
API_PATTERNS = words(
    ("js", "ts", "jsx", "tsx", "py", "java"),
    "/api/", "/rest/", "fetch(", "axios.", "api.get", "api.post", "@RequestMapping", "@GetMapping", "@PostMapping",
    "app.get(", "app.post(", "router.get(", "router.post(",
)
COMPOSITES = {
    "is_deno_project": IS_DENO,
    "has_danet_imports": DANET_IMPORTS,
    "has_danet_decorators": DANET_DECORATORS,
    "has_danet_structure": DANET_STRUCTURE,
    "has_jsx_content": JSX_CONTENT,
    "has_nextjs_patterns": NEXT_PATTERNS,
}

CONFIG, IMPORT, CONTENT, STRUCTURE = "ConfigFile", "ImportPattern", "ContentPattern", "FileStructure"
# (framework, evidence type or None, source, pattern, [(weight, test), ...]); the parts of one rule add up.
BASIC = [
    ("Flask", CONFIG, "requirements.txt", "Flask dependency", [(30, inside("requirements.txt", "Flask", "flask"))]),
    ("Flask", None, "requirements.txt", "Flask extensions", [(5, inside("requirements.txt", x)) for x in ["Flask-SQLAlchemy", "Flask-Login", "Flask-WTF", "Flask-Migrate", "Flask-Admin"]]),
    ("Flask", CONFIG, "pyproject.toml", "flask dependency", [(25, inside("pyproject.toml", "flask", "Flask"))]),
    ("Flask", IMPORT, "Python files", "Flask imports", [(20, words(PY, "from flask import", "import flask", "from flask import Flask", "from flask import request", "from flask import jsonify", "from flask import render_template", "Flask(__name__)"))]),
    ("Flask", CONTENT, "Python files", "Flask decorators and functions", [(20, words(PY, "@app.route", "app = Flask(", ".run(debug=", "request.json", "request.form", "session[", "flash(", "url_for(", "redirect("))]),
    ("Flask", STRUCTURE, "Project structure", "Flask file structure", [(10, file("app.py")), (5, file("wsgi.py")), (10, folder("templates")), (5, folder("static")), (5, file("config.py"))]),
    ("Flask", CONTENT, "Python files", "Flask decorators/patterns", [(30, pruned(PY, "@app.route", "Flask(__name__)"))]),
    ("FastAPI", CONFIG, "requirements.txt", "fastapi dependency", [(30, inside("requirements.txt", "fastapi"))]),
    ("FastAPI", None, "requirements.txt", "uvicorn dependency", [(10, inside("requirements.txt", "uvicorn"))]),
    ("FastAPI", IMPORT, "Python files", "FastAPI imports", [(25, pruned(PY, "from fastapi import", "import fastapi"))]),
    ("FastAPI", STRUCTURE, "Project structure", "FastAPI file structure", [(10, file("main.py")), (10, folder("app")), (10, folder("routers"))]),
    ("FastAPI", CONTENT, "Python files", "FastAPI patterns", [(30, pruned(PY, "FastAPI()", "@router", "BaseModel"))]),
    ("React", CONFIG, "package.json", "React dependency", [(30, inside("package.json", '"react"'))]),
    ("React", CONFIG, "package.json", "ReactDOM dependency", [(15, inside("package.json", '"react-dom"'))]),
    ("React", CONFIG, "package.json", "React TypeScript types", [(10, inside("package.json", '"@types/react"'))]),
    ("React", IMPORT, "JS/TS files", "React imports and hooks", [(20, words(JS, "import React", "from 'react'", 'from "react"', "import { useState", "import { useEffect", "import { Component", "import { FC", "import { FunctionComponent"))]),
    ("React", STRUCTURE, "Project structure", "React file structure", [(10, folder("src/components")), (5, folder("public")), (10, file("src/App.tsx", "src/App.jsx")), (5, file("src/index.tsx", "src/index.jsx"))]),
    ("React", CONTENT, "JSX/TSX files", "JSX/TSX content", [(25, JSX_CONTENT)]),
    ("React", CONTENT, "Component files", "React patterns and lifecycle methods", [(15, words(JS, "ReactDOM.render", "createRoot", "render(", "useState(", "useEffect(", "useContext(", "props.", "this.state", "this.setState"))]),
    ("NestJS", CONFIG, "package.json", "@nestjs/core dependency", [(30, inside("package.json", '"@nestjs/core"'))]),
    ("NestJS", None, "package.json", "@nestjs/common dependency", [(10, inside("package.json", '"@nestjs/common"'))]),
    ("NestJS", CONFIG, "nest-cli.json", "NestJS CLI config", [(20, file("nest-cli.json"))]),
    ("NestJS", IMPORT, "TS files", "NestJS imports", [(20, words(JS, "from '@nestjs/"))]),
    ("NestJS", STRUCTURE, "Project structure", "NestJS file structure", [(10, file("main.ts")), (10, folder("src/controllers")), (10, folder("src/services"))]),
    ("NestJS", CONTENT, "TS files", "NestJS decorators", [(30, words(("ts", "js"), "@Controller", "@Injectable", "@Module"))]),
    ("NextJS", CONFIG, "package.json", "Next.js dependency", [(40, inside("package.json", '"next"'))]),
    ("NextJS", CONFIG, "next.config.js", "Next.js config file", [(20, file("next.config.js", "next.config.ts"))]),
    ("NextJS", STRUCTURE, "Project structure", "Next.js file structure", [
        (20, ("all", folder("app"), file("app/layout.tsx"))), (15, ("all", ("not", ("all", folder("app"), file("app/layout.tsx"))), folder("pages"))), (5, folder("public")),
    ]),
    ("NextJS", CONTENT, "JS/TS files", "Next.js patterns", [(20, NEXT_PATTERNS)]),
    ("SpringBoot", CONFIG, "pom.xml", "spring-boot-starter dependencies", [(40, inside("pom.xml", "spring-boot-starter"))]),
    ("SpringBoot", CONFIG, "pom.xml", "Spring Boot parent/dependencies", [(20, inside("pom.xml", "org.springframework.boot"))]),
    ("SpringBoot", CONFIG, "build.gradle", "Spring Boot Gradle dependencies", [(35, inside("build.gradle", "org.springframework.boot", "spring-boot-starter"))]),
    ("SpringBoot", STRUCTURE, "Project structure", "Spring Boot project structure", [(15, ("any", folder("src/main/java"), file("application.yml", "application.properties")))]),
    ("SpringBoot", CONTENT, "Java files", "Spring Boot annotations and patterns", [(25, words(JAVA, "@SpringBootApplication", "@RestController", "@Controller", "@Service", "@Repository", "@Component", "@Autowired", "import org.springframework", "SpringApplication.run", "@GetMapping", "@PostMapping", "@RequestMapping"))]),
    ("SpringBoot", CONFIG, "Configuration files", "Spring Boot configuration files", [(10, file("application.properties")), (10, file("application.yml")), (5, file("bootstrap.yml", "bootstrap.properties"))]),
    ("Danet", IMPORT, "TypeScript files", "@danet/core imports", [(40, DANET_IMPORTS)]),
    ("Danet", CONTENT, "Controller/Service files", "Danet decorators (@Controller, @Injectable)", [(30, DANET_DECORATORS)]),
    ("Danet", CONFIG, "deno.json", "launch-server task", [(20, ("any", inside("deno.json", "launch-server", "danet"), inside("deno.jsonc", "launch-server", "danet")))]),
    ("Danet", STRUCTURE, "Project structure", "Danet module organization", [(10, DANET_STRUCTURE)]),
]
FRAMEWORKS = ["Flask", "FastAPI", "React", "NestJS", "NextJS", "SpringBoot", "Danet"]
# hundredths; True where the bound itself is enough
THRESHOLDS = {"Flask": (30, True), "FastAPI": (30, True), "React": (30, True), "NestJS": (30, True), "NextJS": (40, True), "SpringBoot": (30, False), "Danet": (30, False)}
GATES = {"Danet": IS_DENO}
# tenths
QUALITY = {CONFIG: 12, IMPORT: 11, CONTENT: 10, STRUCTURE: 8}
WEIGHTED = ["React", "SpringBoot", "Danet"]
DIVERSITY = {4: 1.1, 3: 1.05, 2: 1.02, 1: 0.95}
DIVERSITY_NONE = 0.9
CROSS = {
    "React": (0.7, NEXT_HINTS),
    "Danet": (0.3, ("all", file("package.json"), ("not", IS_DENO))),
    "NestJS": (0.2, IS_DENO),
}
EXTENT_BASIC = [(0.85, "Core"), (0.65, "Extensive"), (0.45, "Moderate")]
EXTENT_ENHANCED = [(0.9, "Core"), (0.7, "Extensive"), (0.5, "Moderate")]
LOWEST_EXTENT = "Limited"

PACKS = {
    "Python": ["Flask", "FastAPI"],
    "JavaScript": ["React"],
    "TypeScript": ["React", "NestJS", "NextJS"],
    "Java": ["SpringBoot"],
    "Deno": ["Danet"],
    "Mixed": FRAMEWORKS,
}
FULLSTACK_PAIRS = [("React", "Express"), ("Django", "React"), ("FastAPI", "React"), ("SpringBoot", "React")]
SERVER_FRAMEWORKS = ["Express", "NestJS", "FastAPI", "Flask", "Django", "SpringBoot", "Danet"]
CONFLICTING = [("Danet", "NestJS"), ("React", "NextJS")]

ENHANCED = [
    ("Flask", 40, words(PY, "from flask import")),
    ("Flask", 35, words(PY, "@app.route")),
    ("Flask", 30, words(PY, "app = Flask(__name__)", "Flask(__name__)")),
    ("Flask", 25, words(PY, "Blueprint", "from flask import Blueprint")),
    ("Flask", 20, words(PY, "from flask import request", "request.json", "request.form")),
    ("Flask", 20, words(PY, "render_template", "from flask import render_template")),
    ("Flask", 15, ("any", words(PY, "flask-"), inside("requirements.txt", "Flask-"))),
    ("Flask", 25, inside("requirements.txt", "Flask")),
    ("Flask", 10, words(PY, "@app.cli.command")),
    ("FastAPI", 40, words(PY, "from fastapi import")),
    ("FastAPI", 35, words(PY, "FastAPI()", "app = FastAPI")),
    ("FastAPI", 35, words(PY, "@app.get", "@app.post", "@app.put", "@app.delete")),
    ("FastAPI", 30, words(PY, "from pydantic import", "BaseModel")),
    ("FastAPI", 25, words(PY, "Depends(", "from fastapi import Depends")),
    ("FastAPI", 25, words(PY, "add_middleware", "@app.middleware")),
    ("FastAPI", 20, words(PY, "async def")),
    ("FastAPI", 25, inside("requirements.txt", "fastapi")),
    ("FastAPI", 15, words(PY, "Response", "from fastapi.responses import")),
    ("React", 40, inside("package.json", '"react":')),
    ("React", 35, words(("tsx", "jsx"), "import React")),
    ("React", 30, words(("tsx", "jsx"), "return (")),
    ("React", 30, words(JS, "useState")),
    ("React", 25, words(("tsx", "jsx"), "function Component", "const ")),
    ("React", 25, ("any", inside("package.json", "react-dom"), words(("ts",), "ReactDOM"))),
    ("React", 20, inside("package.json", "react-scripts", "@types/react")),
    ("React", 15, ("any", inside("package.json", "react-router"), words(("tsx",), "BrowserRouter"))),
    ("NestJS", 40, inside("package.json", "@nestjs/core")),
    ("NestJS", 35, words(("ts",), "@Controller", "@Injectable", "@Module")),
    ("NestJS", 30, words(("ts",), "NestFactory.create")),
    ("NestJS", 30, words(("ts",), "@Get(", "@Post(", "@Put(", "@Delete(")),
    ("NestJS", 25, words(("ts",), "@Inject(", "constructor(")),
    ("NestJS", 25, words(("ts",), "@UseGuards", "@UsePipes")),
    ("NestJS", 20, ("suffix", ".spec.ts", ("@nestjs/testing",))),
    ("NestJS", 15, inside("nest-cli.json", "nest")),
    ("SpringBoot", 40, ("any", inside("pom.xml", "spring-boot-starter"), inside("build.gradle", "spring-boot-starter"))),
    ("SpringBoot", 40, words(JAVA, "@SpringBootApplication")),
    ("SpringBoot", 35, words(JAVA, "@RestController", "@Controller")),
    ("SpringBoot", 30, words(JAVA, "@GetMapping", "@PostMapping", "@RequestMapping")),
    ("SpringBoot", 25, words(JAVA, "@Autowired", "@Component", "@Service")),
    ("SpringBoot", 25, ("any", words(JAVA, "@Configuration"), words(("properties",), "spring."), words(("yml",), "spring:"))),
    ("SpringBoot", 20, ("any", words(JAVA, "@Entity", "@Repository"), inside("pom.xml", "spring-boot-starter-data-jpa"))),
    ("SpringBoot", 15, words(JAVA, "@SpringBootTest")),
]
RUST = [
    ("Axum", ("any", inside("Cargo.toml", "axum"), words(("rs",), "use axum::", "axum::"))),
    ("Actix", ("any", inside("Cargo.toml", "actix-web"), words(("rs",), "use actix_web::", "actix_web::"))),
    ("Warp", ("any", inside("Cargo.toml", "warp"), words(("rs",), "use warp::", "warp::"))),
]
RUST_POINTS = 95
LISTED = [
    ("Flask", "ImportPattern", "Python files", "from flask import", 40, words(PY, "from flask import")),
    ("Flask", "DecoratorPattern", "Python files", "@app.route", 35, words(PY, "@app.route")),
    ("Flask", "ConfigFile", "requirements.txt", "Flask dependency", 25, inside("requirements.txt", "Flask")),
    ("FastAPI", "ImportPattern", "Python files", "from fastapi import", 40, words(PY, "from fastapi import")),
    ("FastAPI", "DecoratorPattern", "Python files", "FastAPI route decorators", 35, words(PY, "@app.get")),
    ("FastAPI", "FrameworkInstance", "Python files", "FastAPI() instantiation", 35, words(PY, "FastAPI()")),
    ("React", "ConfigFile", "package.json", "React dependency", 40, inside("package.json", '"react":')),
    ("React", "ImportPattern", "TypeScript files", "React imports", 35, words(("tsx",), "import React")),
    ("React", "HookPattern", "TypeScript files", "React hooks usage", 30, words(("tsx",), "useState")),
    ("NestJS", "ConfigFile", "package.json", "@nestjs/core dependency", 40, inside("package.json", "@nestjs/core")),
    ("NestJS", "DecoratorPattern", "TypeScript files", "NestJS decorators", 35, words(("ts",), "@Controller")),
    ("NestJS", "FrameworkInstance", "TypeScript files", "NestJS application bootstrap", 30, words(("ts",), "NestFactory.create")),
    ("SpringBoot", "ConfigFile", "pom.xml", "Spring Boot starter dependencies", 40, inside("pom.xml", "spring-boot-starter")),
    ("SpringBoot", "AnnotationPattern", "Java files", "@SpringBootApplication", 40, words(JAVA, "@SpringBootApplication")),
    ("SpringBoot", "AnnotationPattern", "Java files", "Spring MVC annotations", 35, words(JAVA, "@RestController")),
]

# Architecture: detected names of the component view, then the ordered choice.
NAMED = [
    ("Next.js", inside("package.json", '"next"')),
    ("NestJS", ("any", inside("package.json", '"@nestjs/core"', '"@nestjs/common"'), words(("ts",), "from '@nestjs/common'", "from '@nestjs/core'", "import { NestFactory }"))),
    ("Danet", ("any", inside("deno.json", "danet"), inside("deno.jsonc", "danet"), inside("import_map.json", "danet"), words(TS, "deno.land/x/danet"))),
    ("Fresh", ("any", inside("deno.json", "fresh"), inside("deno.jsonc", "fresh"))),
    ("Oak", ("any", inside("deno.json", "oak"), inside("deno.jsonc", "oak"), inside("import_map.json", "oak"))),
    ("Deno Runtime", file("deno.json", "deno.jsonc", "import_map.json")),
    ("React", inside("package.json", '"react"')),
    ("TypeScript", inside("package.json", '"typescript"', '"@types/')),
]
ARCHITECTURES = [
    ("Next.js", "SSR/SSG with React"),
    ("NestJS", "Modular Backend API with NestJS"),
    ("Danet", "Deno Backend API with Danet (NestJS-like)"),
    ("Fresh", "Deno Fullstack with Fresh"),
    ("Oak", "Deno Backend API with Oak"),
    ("Deno Runtime", "Deno Application"),
    ("React", "SPA with React"),
]
DEFAULT_ARCHITECTURE = "Web Application"

# Deno detail: (evidence type, weight, test); probes look at most three levels deep.
SHALLOW = 3
DANET_DETAIL = [
    ("DenoConfig", 40, file("deno.json", "deno.jsonc")),
    ("DenoConfig", 10, ("not", file("package.json"))),
    ("NativeTypeScript", 10, ("all", ("depth", 2, ("ts",), ()), ("not", file("tsconfig.json")))),
    ("DenoConfig", 5, ("any", inside("deno.json", '"imports"'), inside("deno.jsonc", '"imports"'))),
    ("DenoBuiltinTools", 5, ("any", inside("deno.json", '"deno '), inside("deno.jsonc", '"deno '))),
    ("DenoPermissions", 5, ("any", inside("deno.json", '"permissions"'), inside("deno.jsonc", '"permissions"'))),
    ("DanetImport", 20, ("depth", SHALLOW, ("ts", "js"), ('from "danet"', "from 'danet'"))),
    ("DenoUrlImport", 15, ("depth", SHALLOW, ("ts", "js"), ('from "https://deno.land/x/danet',))),
    ("DanetImport", -30, ("all", ("depth", SHALLOW, ("ts", "js"), ('from "@nestjs/',)), ("not", ("depth", SHALLOW, ("ts", "js"), ('from "danet"', "from 'danet'"))))),
    ("DenoBuiltinTools", 5, inside("scripts/dev.sh", "deno run")),
    ("DenoBuiltinTools", 5, inside("Makefile", "deno ")),
    ("ModuleStructure", 10, file("mod.ts")),
    ("NativeTypeScript", 10, inside("src/main.ts", "Deno.serve", "deno.land")),
]
URL_IMPORT_WORD = 'from "https://deno.land/x/danet'
URL_IMPORT_POINTS = 10
DANET_PROJECT_POINTS = 70

SEGMENT_PATTERNS = [
    ("React", "useState hook", ["usestate"]),
    ("React", "useEffect hook", ["useeffect"]),
    ("React", "JSX syntax", ["jsx", "tsx"]),
    ("React", "Props usage", ["props"]),
    ("NestJS", "@Controller decorator", ["@controller"]),
    ("NestJS", "@Injectable decorator", ["@injectable"]),
    ("NestJS", "HTTP method decorators", ["@get", "@post"]),
    ("Flask", "Flask route decorator", ["@app.route"]),
    ("Flask", "Flask request object", ["request"]),
    ("Flask", "Flask jsonify", ["jsonify"]),
    ("SpringBoot", "@RestController annotation", ["@restcontroller"]),
    ("SpringBoot", "@RequestMapping annotation", ["@requestmapping"]),
    ("SpringBoot", "@Service annotation", ["@service"]),
    ("SpringBoot", "JPA @Entity annotation", ["@entity"]),
]

ROUTES = {"react": '"react"', "spring": "spring-boot"}
