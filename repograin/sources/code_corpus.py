"""Code corpus derived from the ``documents`` table.

Each document becomes one file of some repository: its id picks repository,
language and file kind, and the whole text of the document is the file's tail.
The recipe is a set of plain SQL expressions, so any engine can derive the
same ``files`` table. The number of repositories grows with the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repograin.session import SCAN_PARTITIONS

# Files per repository; repositories grow with the table.
DOCS_PER_REPO = 40

# kind -> (path, head). {id} is the document id, {r} the repository number,
# {n} the next repository's number, {d} a digit 1-9, {v} a number 0-6.
KINDS: dict[str, tuple[str, str]] = {
    "flask": (
        "src/auth/login_{id}.py",
        "from flask import Flask, request\napp = Flask(__name__)\n@app.route('/auth/login', methods=['POST'])\n"
        "def login_{id}(name: str, password: str) -> str:\n    token = request.json\n    return redirect('/profile')\n"
        "@app.route('/users')\nasync def list_users_{id}():\n    return session['user']\n",
    ),
    "fastapi": (
        "app/routers/items_{id}.py",
        "from fastapi import FastAPI, Depends\nfrom pydantic import BaseModel\nimport requests\napp = FastAPI()\n"
        "class Item{id}(BaseModel):\n    title: str\n    price: float\n@router.get('/items/{id}')\n"
        "async def get_item_{id}(q: str = None) -> Item{id}:\n    raise NotImplementedError\n"
        "def create_item(item):\n    db.execute('INSERT INTO product VALUES (1)')\n",
    ),
    "sqlalchemy": (
        "src/models/product_model_{id}.py",
        "from flask_sqlalchemy import SQLAlchemy\nfrom datetime import date\nclass Product{id}(db.Model):\n"
        "    __tablename__ = 'products_{v}'\n    name = db.Column(db.String)\n    price = db.Column(db.Float)\n"
        "    orders = db.relationship('Order')\n    def save(self):\n        db.session.add(product)\n"
        "class Cart(models.Model):\n    title = models.CharField()\n    owner = models.ForeignKey(User)\n",
    ),
    "pyservice": (
        "src/services/payment_service_{id}.py",
        "import stripe\nimport os\nfrom django.db import models\nclass PaymentService{v}:\n"
        "    def create_order(self, user):\n        invoice = stripe.charge(amount)\n        order.save()\n"
        "    def generate_report(self):\n        return metrics\n    def delete_order(self, order):\n        if user:\n            print(user)\n        pass\n"
        "    def update_order(self, order):\n        for item in cart:\n            product.update()\n",
    ),
    "nestservice": (
        "src/users/user_{id}.service.ts",
        "import { Injectable } from '@nestjs/common';\nimport { Repository } from 'typeorm';\n@Injectable()\n"
        "export class UserService{v} extends BaseService implements OnInit {\n  constructor(private repo: Repository) {}\n"
        "  async findUser(id: string, active: boolean): Promise<User> {\n    const user = await this.repo.findOne(id);\n"
        "    if (user) { return user; }\n  }\n  async createUser(dto: UserDto) {\n    return this.repo.save(dto);\n  }\n}\n"
        "interface UserDto{id} {\n  name: string;\n  email?: string;\n}\n",
    ),
    "nestcontroller": (
        "src/controllers/order_{id}.controller.ts",
        "import { Controller, Get, Post } from '@nestjs/common';\nimport axios from 'axios';\n@Controller('orders')\n"
        "export class OrderController{v} {\n  @ApiOperation()\n  @Get('/orders/{id}')\n  async getOrder(id: string) {\n"
        "    return axios.get('/orders/{id}');\n  }\n  @Post('/orders')\n  createOrder(order: OrderDto) {\n"
        "    fetch('/api/checkout/{v}');\n  }\n  @Delete('/orders/{id}')\n  deleteOrder(id) {\n    return order.delete();\n  }\n}\n",
    ),
    "react": (
        "src/components/UserCard{id}.tsx",
        "import React, { useState, useEffect } from 'react';\nimport axios from 'axios';\nimport { Button } from './Button{v}';\nimport App from 'App';\n"
        "interface UserCard{id}Props {\n  userName: string;\n  age?: number;\n}\n"
        "export const UserCard{id}: React.FC<UserCard{id}Props> = ({ userName, age }) => {\n"
        "  const [user, setUser] = useState(null);\n  useEffect(() => { fetch('/api/users/{id}').then(r => r.json()); }, []);\n"
        "  return <div className=\"card\">{userName}</div>;\n};\n",
    ),
    "nextapi": (
        "pages/api/items_{id}.ts",
        "import type { NextApiRequest } from 'next';\nimport { useRouter } from 'next/router';\n"
        "export default async function handler(req, res) {\n  const items = await prisma.item.findMany();\n"
        "  res.status(200).json(items);\n}\nexport async function getServerSideProps() {\n  return { props: {} };\n}\n",
    ),
    "express": (
        "src/views/dashboard_{id}.js",
        "const express = require('express');\nconst app = express();\napp.get('/dashboard/{id}', (req, res) => {\n"
        "  console.log('metrics');\n  res.send('report');\n});\napp.post('/cart', addToCart);\nfunction addToCart(req, res) {\n"
        "  throw new Error('not implemented');\n}\n",
    ),
    "springcontroller": (
        "src/main/java/com/shop/Payment{id}Controller.java",
        "package com.shop;\nimport org.springframework.web.bind.annotation.GetMapping;\nimport java.util.List;\n"
        "@RestController\n@RequestMapping(\"/payments\")\npublic class Payment{id}Controller {\n    private String card;\n"
        "    @GetMapping(\"/payments/{id}\")\n    public List<Payment> getPayments(String user, int page) {\n        return null;\n    }\n"
        "    @PostMapping(value = \"/payments\")\n    public Payment createPayment(Payment payment) throws IOException {\n"
        "        if (payment != null) { repository.save(payment); }\n        return payment;\n    }\n}\n",
    ),
    "jpa": (
        "src/main/java/com/shop/Order{id}Entity.java",
        "package com.shop;\nimport javax.persistence.Entity;\n@Entity\n@Table(name = \"orders_{v}\")\n"
        "public class Order{id}Entity extends BaseEntity implements Serializable {\n    @Id\n    private Long id;\n"
        "    @Column(nullable = false)\n    private String status;\n    @ManyToOne\n    private Customer customer;\n"
        "    public Long getId() { return id; }\n}\n",
    ),
    "javaservice": (
        "src/main/java/com/shop/InventoryService{id}.java",
        "package com.shop;\nimport org.springframework.stereotype.Service;\n@Service\npublic class InventoryService{id} {\n"
        "    @Autowired\n    private StockRepository repository;\n    public void updateStock(Product product) {\n"
        "        for (Item item : items) { repository.save(item); }\n        System.out.println(product);\n    }\n"
        "    public Item findById(Long id) {\n        throw new UnsupportedOperationException();\n    }\n}\n",
    ),
    "axum": (
        "src/handlers/route_{id}.rs",
        "use axum::{Router, routing::get};\nuse tokio::net::TcpListener;\npub async fn health_{id}() -> String {\n"
        "    unimplemented!()\n}\npub fn app() -> Router {\n    Router::new().route(\"/health/{id}\", get(health_{id}))\n}\n"
        "type Account{v} = String;\n",
    ),
    "go": (
        "internal/format_{id}.go",
        "package format\nimport \"fmt\"\nfunc Format{id}(name string) string {\n\treturn fmt.Sprintf(name)\n}\n",
    ),
    "danet": (
        "src/modules/app_{id}.ts",
        "import { Module, Controller, Get } from \"jsr:@danet/core@2.{v}.1\";\nimport { serve } from \"https://deno.land/std/http/server.ts\";\n"
        "@Controller('booking')\nexport class BookingController{v} {\n  @Get('/rooms/{id}')\n  getRooms() {\n    return this.rooms.find();\n  }\n}\n"
        "@Module({ controllers: [BookingController{v}] })\nexport class AppModule {}\n",
    ),
    "danetservice": (
        "src/services/booking_{id}.service.ts",
        "import { Injectable } from \"jsr:@danet/core@2.{v}.1\";\n@Injectable()\nexport class BookingService{v} {\n"
        "  async reserve(guest: string, room: number): Promise<void> {\n    await Deno.writeTextFile(guest, 'hotel');\n  }\n}\n",
    ),
    "guide": (
        "docs/guide_{id}.md",
        "# Overview\nSupports OAuth authentication and a REST API.\nBuilt with React and PostgreSQL v1{v}.2, deploy using Docker.\n"
        "## Installation\n```\n$ npm install\n`pip install flask==2.{v}.0`\n```\nConfigure the environment settings for version: 3.{v}. Then start.\n"
        "## Usage\nThe client connects to Stripe for payments and real-time notifications.\nHandles 50{v} concurrent users with caching.\n"
        "## API\nProvides CRUD operations over the JSON API with secure encrypted tokens.\n### Notes\n",
    ),
    "architecture": (
        "docs/architecture_{id}.md",
        "# Architecture\nThis project is part of shop-unit-{n} and shares PostgreSQL and Redis with other services.\n"
        "The shop-unit-{n}-gateway calls shop_unit_{n} over a REST API; Docker and Kubernetes host the microservice.\n"
        "## Configuration\nSet config values in the settings file.\n## API Reference\nEndpoints of the backend service integrate with shop-unit-{n}.\n"
        "## Contributing\nPlease open a merge request.\n",
    ),
    "readme": (
        "README.md",
        "# shop-unit-{r}\nA web app for online store orders and payment.\n## About\n"
        "An e-commerce platform component with login, product catalog and checkout, part of the shop-unit-{n} parent project.\n"
        "## Setup\nnpm install express\ndocker build .\n## Quick Start\nRun the server, a command line tool is included to format reports.\n"
        "## License\nMIT\n",
    ),
    "jvmguide": (
        "docs/guide_{id}.md",
        "# About\nThe Java backend includes order and billing modules, powered by Spring Boot and MySQL.\nA React client is planned.\n"
        "## Getting Started\nmvn clean install\nRequirements: Java 1{v}.0 dependencies.\n## Usage\nAble to audit user management over https.\n",
    ),
    "jvmreadme": (
        "README.md",
        "# shop-unit-{r}\nAn API server for inventory reports.\n## What is it\nA backend service using Kubernetes, sibling of the shop-unit-{n} system.\n"
        "## Installation\ngradle build\n## Examples\nSee the guide.\n",
    ),
    "vendored": ("node_modules/lib_{id}/index.js", "module.exports = function () {}\n// TODO vendored code\n"),
    "pytest": (
        "tests/test_case_{id}.py",
        "import pytest\ndef test_case_{id}():\n    assert True\ndef test_user_login():\n    mock = fixture()\n    assert mock\n",
    ),
    "docker": ("deploy/unit_{id}/Dockerfile", "FROM python:3.{v}\nCOPY . /srv\nRUN pip install -r requirements.txt\nCMD python app.py\n"),
    "workflow": (".github/workflows/ci_{id}.yml", "name: ci\non: push\njobs:\n  deploy:\n    env: staging\n    run: docker compose up\n"),
}

# ecosystem -> kinds taking turns in the code slots
ECOSYSTEMS: list[list[str]] = [
    ["flask", "sqlalchemy", "fastapi", "pyservice"],
    ["nestservice", "nestcontroller", "react", "nextapi", "express"],
    ["springcontroller", "jpa", "javaservice"],
    ["axum", "go", "axum"],
    ["danet", "danetservice", "nestservice"],
    ["flask", "react", "nestcontroller", "springcontroller", "axum", "fastapi", "nextapi", "pyservice", "jpa", "express"],
]
FIXED_SLOTS = {4: "guide", 6: "vendored", 7: "pytest", 14: "readme", 16: "docker", 17: "workflow", 24: "guide", 26: "vendored", 27: "pytest", 34: "architecture", 36: "docker", 37: "workflow"}
# Kinds that replace another one in an ecosystem.
VARIANTS = {(2, "guide"): "jvmguide", (2, "readme"): "jvmreadme"}

MARKERS = [
    "# TODO: urgent login check @dev{v} 2024-01-0{d} #auth #team-{v}\n",
    "// FIXME: slow query in api endpoint {v}\n",
    "// HACK refactor the cache layer and implement the new eviction policy for all of it now\n",
    "/* NOTE see ui component {v} */\n",
    "<!-- BUG: crash when rendering {v} -->\n",
    "",
    "# deprecated remove old spec\n",
]

# ecosystem -> manifest files of a repository (path, text)
MANIFESTS: list[list[tuple[str, str]]] = [
    [
        ("requirements.txt", "# deps\nFlask==2.{r}\nFlask-Login>=0.6\nbcrypt>=4.0\npandas\nfastapi~=0.110\nuvicorn<1\nclick\n"),
        ("app.py", "from flask import Flask\napp = Flask(__name__)\ndef create_app():\n    return login_{id}\n"),
    ],
    [
        (
            "package.json",
            '{"name":"shop-unit-{r}","version":"1.{r}.0","description":"web app for orders","license":"MIT",'
            '"repository":{"url":"git+shop/{r}"},"author":"dev{v}","dependencies":{"react":"^18.2.0","react-dom":"^18.2.0",'
            '"axios":"^1.0.0","express":"^4.0.0","@nestjs/core":"10.{v}.0","@nestjs/common":"10.0.0","passport":"0.6"},'
            '"devDependencies":{"jest":"^29.0.0","typescript":"5.0.{v}"}}',
        ),
        ("tsconfig.json", "{}\n"),
        ("src/App.tsx", "import React from 'react';\nexport default function App() {\n  return <Main/>;\n}\n"),
        ("nest-cli.json", "{}\n"),
        ("src/main.ts", "export function bootstrap() {\n  App.render();\n}\n"),
    ],
    [
        (
            "pom.xml",
            "<project>\n<groupId>org.springframework.boot</groupId>\n<artifactId>spring-boot-starter-web</artifactId>\n"
            "<version>3.1.{v}</version>\n</project>\n",
        ),
        ("application.yml", "server:\n  port: 80\n"),
    ],
    [
        (
            "Cargo.toml",
            '[package]\nname = "shop-unit-{r}"\nversion = "0.{r}.1"\ndescription = "command line tool"\n[dependencies]\naxum = "0.7"\n'
            'tokio = { version = "1.{v}", features = ["full"] }\nredis = { version = "0.23" }\nclap = { git = "x" }\n'
            '[dev-dependencies]\nmockall = "0.11"\n[features]\nfull = []\n',
        ),
        ("src/main.rs", "fn main() {}\n"),
    ],
    [
        (
            "deno.json",
            '{"name":"shop-unit-{r}","version":"0.{r}.0","imports":{"@danet/core":"jsr:@danet/core@2.{v}.1","std/":"https://deno.land/std/"},'
            '"tasks":{"launch-server":"deno run main.ts"},"compilerOptions":{"experimentalDecorators":true}}',
        ),
        ("deno.lock", "{}\n"),
    ],
    [
        (
            "package.json",
            '{"name":"shop-unit-{r}","version":"2.{r}.0","dependencies":{"next":"13.{v}.0","react":"^18.2.0","stripe":"^12.0.0"},'
            '"devDependencies":{"jest":"^29.0.0"}}',
        ),
        ("requirements.txt", "django>=4.{v}\nfastapi==0.1{v}\n"),
        ("next.config.js", "module.exports = {}\n"),
    ],
]

_FILL = {
    "{id}": "CAST(doc_id AS STRING)",
    "{r}": "CAST(CAST(floor(doc_id / 40) AS BIGINT) AS STRING)",
    "{n}": "CAST(CAST(floor(doc_id / 40) AS BIGINT) + 1 AS STRING)",
    "{d}": "CAST(1 + doc_id % 9 AS STRING)",
    "{v}": "CAST(doc_id % 7 AS STRING)",
}

REPO_NO_SQL = "CAST(floor(doc_id / 40) AS BIGINT)"
REPO_SQL = f"concat('shop-unit-', CAST({REPO_NO_SQL} AS STRING))"
SLOTS = 40
# Position: ecosystem * SLOTS + slot.
KIND_TABLE = [
    VARIANTS.get((eco, FIXED_SLOTS.get(slot)), FIXED_SLOTS.get(slot, kinds[slot % 20 % len(kinds)]))
    for eco, kinds in enumerate(ECOSYSTEMS)
    for slot in range(SLOTS)
]


def fill_sql(template: str) -> str:
    """SQL that puts the document's numbers into a template expression."""
    for slot, value in _FILL.items():
        template = f"replace({template}, '{slot}', {value})"
    return template


def _fill(template: Column) -> Column:
    for slot, value in _FILL.items():
        template = F.replace(template, F.lit(slot), F.expr(value))
    return template


def _pick(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows to as many partitions as the session asks for; without that setting the scan's own stay."""
    asked = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(asked)) if asked else df


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files(repo, path, ext, lang, length, modified, content)`` of the derived corpus."""
    from repograin.sources.corpus import with_file_columns

    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    eco = F.expr(f"{REPO_NO_SQL} % {len(ECOSYSTEMS)}")
    slot = (eco * SLOTS + F.col("doc_id") % SLOTS + 1).cast("int")
    kind = F.element_at(F.array(*[F.lit(k) for k in KIND_TABLE]), slot)
    marker = F.element_at(F.array(*[F.lit(m) for m in MARKERS]), (F.col("doc_id") % 7 + 1).cast("int"))
    repo, modified = F.expr(REPO_SQL).alias("repo"), (F.lit(1700000000) + F.col("doc_id") * 60).alias("modified")
    body = docs.withColumn("kind", kind).select(
        repo,
        _fill(_pick({k: p for k, (p, _) in KINDS.items()}, F.col("kind"))).alias("path"),
        F.concat(_fill(F.concat(_pick({k: h for k, (_, h) in KINDS.items()}, F.col("kind")), marker)), F.col("text")).alias("content"),
        modified,
    )
    # Manifests come from each repository's least document.
    per_eco = F.element_at(
        F.array(*[F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("content")) for p, t in ms]) for ms in MANIFESTS]),
        (eco + 1).cast("int"),
    )
    least = docs.groupBy(F.expr(REPO_SQL)).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    manifests = least.select(
        repo, "doc_id", F.explode(per_eco).alias("m")
    ).select("repo", _fill(F.col("m.path")).alias("path"), _fill(F.col("m.content")).alias("content"), modified)
    return with_file_columns(body.unionByName(manifests))
