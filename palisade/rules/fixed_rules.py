"""Detection rule values.

Everything in this module is a fixed value: names, patterns, severities, advice
texts and package lists that results have to carry unchanged.  No logic lives
here; the patterns are ECMAScript regular expressions and go through
``functions.dialect`` before Spark sees them.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    id: str
    name: str
    pattern: str
    severity: str
    fix: str
    cwe: str | None = None
    breach: str | None = None


class WebhookProvider(NamedTuple):
    provider: str
    endpoints: tuple[str, ...]
    proofs: tuple[str, ...]
    severity: str
    fix: str
    breach: str | None = None


# Injection rules (ignoring case).
INJECTION_RULES: tuple[Rule, ...] = (
    Rule(
        'sql-template-literal',
        'SQL Injection via Template Literal',
        r"(query|execute|\$queryRaw|\$executeRaw)\s*\(\s*`[^`]*\$\{",
        'critical',
        "Use parameterized queries: db.query('SELECT * FROM users WHERE id = ?', [id])",
        'CWE-89',
        'SQL injection is #1 on OWASP Top 10. AI frequently uses string interpolation in queries.',
    ),
    Rule(
        'sql-string-concat',
        'SQL Injection via String Concatenation',
        r"""(query|execute)\s*\(\s*['"]SELECT.*\+\s*(req|params|query|body)""",
        'critical',
        'Use parameterized queries instead of string concatenation.',
        'CWE-89',
        None,
    ),
    Rule(
        'unsanitized-body-insert',
        'Unsanitized req.body to Database',
        r"\.(insert|create|update)\s*\(\s*req\.body",
        'critical',
        'Validate with Zod/Yup/Joi before passing to database: const validated = schema.parse(req.body)',
        'CWE-20',
        None,
    ),
    Rule(
        'command-injection-exec',
        'Command Injection via exec()',
        r"(exec|execSync)\s*\([^)]*req\.(body|query|params)",
        'critical',
        'Never pass user input to exec/eval. Use a whitelist of allowed commands.',
        'CWE-78',
        'CurXecute CVE-2025-54135: command injection via MCP config.',
    ),
    Rule(
        'command-injection-eval',
        'Code Injection via eval()',
        r"eval\s*\([^)]*req\.(body|query|params)",
        'critical',
        'Never use eval() with user input. Parse JSON with JSON.parse() instead.',
        'CWE-94',
        None,
    ),
    Rule(
        'nosql-injection',
        'NoSQL Injection',
        r"\.(find|findOne|updateOne|deleteOne)\s*\(\s*req\.body",
        'critical',
        'Validate and sanitize input before passing to MongoDB queries.',
        'CWE-943',
        None,
    ),
    Rule(
        'xss-innerhtml',
        'XSS via innerHTML',
        r"innerHTML\s*=\s*(req|params|query|body|user)",
        'critical',
        'Use textContent instead of innerHTML, or sanitize with DOMPurify.',
        'CWE-79',
        None,
    ),
    Rule(
        'xss-dangerously-set',
        'XSS via dangerouslySetInnerHTML',
        r"dangerouslySetInnerHTML\s*=\s*\{\{\s*__html\s*:",
        'warning',
        'Avoid dangerouslySetInnerHTML. If necessary, sanitize with DOMPurify first.',
        'CWE-79',
        None,
    ),
    Rule(
        'idor-params-id',
        'Insecure Direct Object Reference (IDOR)',
        r"\.(findById|findOne|findUnique|update|delete|deleteOne|updateOne)\s*\(\s*\{?\s*(id|_id)?\s*:?\s*req\.(params|query)\.id",
        'critical',
        'Always check ownership before reading/mutating: ensure the requesting user owns the resource (e.g. WHERE id = $1 AND user_id = $2).',
        'CWE-639',
        'IDOR is OWASP Top 10. Optus 2022 breach: 9.8M records exposed via missing ownership check on /api/users/:id.',
    ),
    Rule(
        'idor-prisma-where-id-only',
        'Prisma query keyed only by req.params.id (likely IDOR)',
        r"where\s*:\s*\{\s*id\s*:\s*req\.(params|query)\.(id|userId|orderId)",
        'critical',
        'Add the current user to the where clause: where: { id: req.params.id, userId: req.user.id }.',
        'CWE-639',
        None,
    ),
    Rule(
        'mass-assignment-spread',
        'Mass assignment via ...req.body spread',
        r"\.(create|update|insert|save|updateOne|findOneAndUpdate)\s*\([^)]*\.\.\.req\.body",
        'critical',
        'Never spread req.body into a database write. Whitelist fields with Zod/Yup or pick only the allowed keys (e.g. { title, body } = req.body).',
        'CWE-915',
        'GitHub 2012: mass assignment let any user grant themselves admin by adding `is_admin: true` to a PATCH body.',
    ),
    Rule(
        'mass-assignment-object-assign',
        'Mass assignment via Object.assign(user, req.body)',
        r"Object\.assign\s*\([^,]+,\s*req\.body",
        'critical',
        'Do not merge req.body straight into a model. Whitelist fields with a schema validator before updating.',
        'CWE-915',
        None,
    ),
    Rule(
        'ssrf-user-url',
        'Server-Side Request Forgery (SSRF) via user-supplied URL',
        r"(fetch|axios|axios\.get|axios\.post|got|needle|superagent\.(get|post)|http\.get|https\.get|http\.request|https\.request)\s*\(\s*[^)]*req\.(query|body|params)",
        'critical',
        "Don't request a URL built from user input. Validate it against an allowlist of hosts, block internal/metadata addresses (169.254.169.254, localhost, 10./172.16./192.168.), and disable redirects.",
        'CWE-918',
        'Capital One 2019: an SSRF to the cloud metadata endpoint exposed 100M+ customer records.',
    ),
    Rule(
        'path-traversal-user-input',
        'Path traversal — file path built from user input',
        r"(readFile|readFileSync|createReadStream|writeFile|writeFileSync|unlink|sendFile|download)\s*\(\s*[^)]*req\.(query|body|params)",
        'critical',
        'Never build a file path from user input. Resolve against a fixed base directory and verify the result stays inside it, or map an ID to a known filename.',
        'CWE-22',
        'Path traversal lets attackers read /etc/passwd, your .env, or source code by sending ../../ sequences.',
    ),
    Rule(
        'code-injection-function-constructor',
        'Code injection via Function constructor',
        r"new\s+Function\s*\([^)]*req\.(body|query|params)",
        'critical',
        'Never build a Function from user input. Use a safe parser or a whitelist of allowed operations.',
        'CWE-94',
        None,
    ),
    Rule(
        'sql-orm-raw-unsafe',
        'SQL injection via raw/unsafe ORM query with interpolation',
        r"(sequelize\.query|knex\.raw|\$queryRawUnsafe|\$executeRawUnsafe)\s*\(\s*`[^`]*\$\{",
        'critical',
        'Use bound parameters or the query builder instead of interpolating values into raw SQL.',
        'CWE-89',
        None,
    ),
    Rule(
        'xss-innerhtml-location',
        'XSS via innerHTML from location/URL',
        r"innerHTML\s*=\s*[^;]*(location|document\.URL|window\.name)",
        'critical',
        "Don't assign untrusted URL/location data to innerHTML. Use textContent, or sanitize with DOMPurify.",
        'CWE-79',
        None,
    ),
    Rule(
        'xss-document-write',
        'XSS via document.write with dynamic input',
        r"document\.write(ln)?\s*\([^)]*(location|searchParams|document\.URL|req\.(query|body|params))",
        'warning',
        'Avoid document.write with any dynamic value. Build DOM nodes and set textContent instead.',
        'CWE-79',
        None,
    ),
)

# Authentication rules (ignoring case).
AUTH_RULES: tuple[Rule, ...] = (
    Rule(
        'password-plaintext-insert',
        'Plain-text password written to database',
        r"\.(insert|create|save|update|updateOne|findOneAndUpdate)\s*\([^)]*password\s*:\s*req\.body\.password",
        'critical',
        'Hash the password with bcrypt or argon2 before storing: const hash = await bcrypt.hash(req.body.password, 12).',
        'CWE-256',
        'RockYou 2009: 32M plain-text passwords leaked. Adobe 2013: 153M weakly-hashed passwords leaked.',
    ),
    Rule(
        'password-md5',
        'Weak password hashing (MD5)',
        r"""crypto\.createHash\s*\(\s*['"]md5['"]\s*\)[^;]*password""",
        'critical',
        'MD5 is broken for passwords. Use bcrypt (cost >= 12) or argon2.',
        'CWE-327',
        None,
    ),
    Rule(
        'password-sha1',
        'Weak password hashing (SHA-1)',
        r"""crypto\.createHash\s*\(\s*['"]sha1['"]\s*\)[^;]*password""",
        'critical',
        'SHA-1 is broken for passwords. Use bcrypt (cost >= 12) or argon2.',
        'CWE-327',
        None,
    ),
    Rule(
        'password-sha256-unsalted',
        'Unsalted SHA-256 used for password',
        r"""crypto\.createHash\s*\(\s*['"]sha256['"]\s*\)[^;]*\.update\([^)]*password""",
        'critical',
        'Plain SHA-256 is too fast and easy to rainbow-table. Use bcrypt or argon2.',
        'CWE-916',
        None,
    ),
    Rule(
        'bcrypt-low-cost',
        'bcrypt cost factor too low',
        r"bcrypt\.(hash|hashSync)\s*\([^,]+,\s*([1-9]|10)\b",
        'warning',
        'Use a bcrypt cost factor of 12 or higher: bcrypt.hash(pw, 12).',
        'CWE-916',
        None,
    ),
    Rule(
        'open-redirect-query',
        'Open redirect using req.query / req.body',
        r"res\.redirect\s*\(\s*req\.(query|body|params)\.(redirect|url|next|return|returnTo)",
        'critical',
        'Validate the redirect target against an allowlist of paths or hostnames before calling res.redirect.',
        'CWE-601',
        'Open redirects are the standard last hop in phishing chains and OAuth account takeovers.',
    ),
    Rule(
        'open-redirect-window',
        'Open redirect via window.location = req.query',
        r"window\.location\s*(\.href)?\s*=\s*[^;]*\.(query|search|hash)",
        'warning',
        'Never assign window.location from untrusted query strings without an allowlist.',
        'CWE-601',
        None,
    ),
    Rule(
        'jwt-hardcoded-secret',
        'Hardcoded JWT signing secret',
        r"""jwt\.sign\s*\([^,]+,\s*['"`][^'"`,)]{6,}['"`]""",
        'critical',
        'Never hardcode the JWT secret. Load it from process.env.JWT_SECRET and use a long random value.',
        'CWE-798',
        'A hardcoded JWT secret lets anyone forge valid tokens and log in as any user.',
    ),
    Rule(
        'jwt-alg-none',
        "JWT 'none' algorithm allowed",
        r"""algorithms?\s*:\s*\[?\s*['"]none['"]""",
        'critical',
        "Never allow the 'none' algorithm. Pin a strong one: jwt.verify(token, secret, { algorithms: ['HS256'] }).",
        'CWE-347',
        "The JWT 'none' algorithm bypass lets attackers submit unsigned tokens that are accepted as valid.",
    ),
    Rule(
        'tls-reject-unauthorized-false',
        'TLS certificate validation disabled',
        r"rejectUnauthorized\s*:\s*false",
        'critical',
        'Remove rejectUnauthorized: false — it disables TLS checks and enables man-in-the-middle attacks. Use a proper CA certificate.',
        'CWE-295',
        None,
    ),
    Rule(
        'tls-node-reject-disabled',
        'Node TLS verification globally disabled',
        r"""NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['"]?0""",
        'critical',
        'Remove NODE_TLS_REJECT_UNAUTHORIZED=0 — it turns off certificate validation for the entire app.',
        'CWE-295',
        None,
    ),
    Rule(
        'cookie-not-httponly',
        'Auth cookie missing HttpOnly',
        r"httpOnly\s*:\s*false",
        'warning',
        "Set httpOnly: true on session/auth cookies so JavaScript (and any XSS) can't read them.",
        'CWE-1004',
        None,
    ),
    Rule(
        'insecure-random-token',
        'Insecure randomness for a security token',
        r"(token|secret|apikey|api_key|sessionid|session_id|otp|nonce|reset|verification)\w*\s*[:=][^;\n]*Math\.random\s*\(",
        'critical',
        "Math.random() is predictable. Use crypto.randomBytes(32).toString('hex') or crypto.randomUUID() for tokens, codes, and secrets.",
        'CWE-338',
        None,
    ),
)

# Webhook providers, their endpoint patterns (ignoring case) and
# the literal texts that prove a signature check.
WEBHOOK_PROVIDERS: tuple[WebhookProvider, ...] = (
    WebhookProvider(
        'stripe',
        (r'stripe.*webhook', r'webhook.*stripe', r'/api/webhook'),
        ('constructEvent', 'stripe-signature'),
        'critical',
        'Add stripe.webhooks.constructEvent(payload, sig, endpointSecret) before processing the event.',
        'CurXecute-style attacks: unverified webhooks allow arbitrary execution.',
    ),
    WebhookProvider(
        'paystack',
        (r'paystack.*webhook', r'webhook.*paystack', r'/api/paystack'),
        ('X-Paystack-Signature', 'createHmac', 'paystack.*signature'),
        'critical',
        'Validate X-Paystack-Signature header using HMAC SHA512 with your Paystack secret key.',
        None,
    ),
    WebhookProvider(
        'mpesa',
        (r'mpesa.*callback', r'callback.*mpesa', r'mpesa.*webhook', r'/api/mpesa'),
        ('request.ip', 'safaricom', 'callback_token', 'validateIp'),
        'critical',
        "Validate M-Pesa callback source IP against Safaricom's known IP range, or verify the callback token.",
        'Unvalidated M-Pesa callbacks allow spoofed successful payment notifications.',
    ),
    WebhookProvider(
        'github',
        (r'github.*webhook', r'webhook.*github', r'/api/github'),
        ('X-Hub-Signature', 'x-hub-signature-256', 'verifySignature', 'createHmac'),
        'critical',
        'Verify the X-Hub-Signature-256 header using HMAC SHA256 with your webhook secret.',
        None,
    ),
    WebhookProvider(
        'flutterwave',
        (r'flutterwave.*webhook', r'webhook.*flutterwave', r'rave.*webhook'),
        ('verif-hash', 'FLWSECK', 'verifyTransactionHash'),
        'critical',
        'Validate the verif-hash header against your Flutterwave secret key.',
        None,
    ),
)

# Packages known to be malicious, with the reason.
KNOWN_MALICIOUS: tuple[tuple[str, str], ...] = (
    ('event-stream', 'Compromised in 2018 to steal Bitcoin wallets. Still referenced in old tutorials.'),
    ('flatmap-stream', 'Malicious dependency injected into event-stream.'),
    ('ua-parser-js-compromised', 'Known malicious fork of ua-parser-js.'),
    ('coa-compromised', 'Supply chain attack on coa package (2021).'),
    ('rc-compromised', 'Supply chain attack on rc package (2021).'),
    ('colors-compromised', 'Malicious fork after colors.js protest.'),
    ('faker-compromised', 'Malicious fork after faker.js protest.'),
    ('node-ipc-malicious', 'Contained protestware targeting Russian IPs (2022).'),
    ('peacenotwar', 'Protestware distributed via node-ipc.'),
    ('crossenv', 'Typosquat of cross-env. Steals environment variables.'),
    ('cross-env.js', 'Typosquat of cross-env.'),
    ('d3.js', 'Typosquat of d3. Contains malicious code.'),
    ('gruntcli', 'Typosquat of grunt-cli.'),
    ('mongose', 'Typosquat of mongoose.'),
    ('mariadb', 'Typosquat of mysql2/mariadb connector (verify before using).'),
    ('discordi.js', 'Typosquat of discord.js.'),
    ('@primordials/core', 'Malicious package exfiltrating env vars (2025).'),
)

# Look-alike names of well-known packages.
TYPOSQUATS: dict[str, tuple[str, ...]] = {
    'lodash': ('lodahs', 'lodashs', 'lo-dash', 'lodash-es-fake', 'loadash', 'lodas',),
    'express': ('expres', 'expresss', 'express-server-fake', 'expess', 'expreses',),
    'react': ('reactt', 'react-dom-fake', 'react-core', 'raect', 'reakt',),
    'axios': ('axois', 'axioss', 'axio', 'axos',),
    'next': ('nextt', 'next-js-fake', 'nextjs-core',),
    'mongoose': ('mongose', 'mongoosee', 'mongoos',),
    'dotenv': ('dot-env', 'dotnev', 'dontenv',),
    'jsonwebtoken': ('json-web-token', 'jsonwebtokens', 'jswonwebtoken',),
    'bcrypt': ('bcrpyt', 'bcryptt', 'bcyrpt',),
    'cors': ('corss', 'cros',),
    'helmet': ('helmett', 'helment',),
    'stripe': ('stripes', 'strip', 'stripee',),
    'socket.io': ('socket-io-fake', 'socketio-client-fake',),
    'typescript': ('typscript', 'tyepscript', 'typescrip',),
    'eslint': ('eslit', 'eslnt', 'elint',),
    'prettier': ('pretier', 'pretieer', 'prettierr',),
    'chalk': ('chalks', 'chlak',),
    'commander': ('comander', 'commanderr',),
    'uuid': ('uuiid', 'uud', 'uuidv4-fake',),
}

# Install-script patterns, first match in this order is reported.
SUSPICIOUS_SCRIPTS: tuple[str, ...] = (
    r"preinstall.*curl",
    r"preinstall.*wget",
    r"preinstall.*node\s+-e",
    r"postinstall.*curl",
    r"postinstall.*wget",
    r"postinstall.*node\s+-e",
    r"postinstall.*\$\(",
    r"preinstall.*env",
    r"install.*exfil",
    r"install.*reverse.shell",
)
