"""Endpoints with full paths, walks in written order, and dependencies in use, on small applications."""

import random

from strandline.operators.ordered_walk import first_ways
from strandline.sources import web_source as W

APP = {
    "main.py": "from fastapi import FastAPI\nfrom api import users, items as things\nfrom api.admin import router as admin\nimport api.extra\napp = FastAPI()\napp.include_router(users.router, prefix='/v1')\napp.include_router(things.router)\nif True:\n    app.include_router(admin, prefix='/admin/')\napp.include_router(api.extra.router)\n@app.get('/health/')\ndef health(): pass\n",
    "api/__init__.py": "",
    "api/users.py": "from fastapi import APIRouter, Depends\nfrom . import items\nfrom ..deps import CurrentUser\nfrom deps import get_db, CurrentUser as Me\nrouter = APIRouter(prefix='/users')\nrouter.include_router(items.router, prefix='{uid}')\n@router.get('/')\ndef all_users(db=Depends(get_db)): pass\n@router.post('/new', response_model=UserOut)\nasync def create(body: UserIn, me: Me): pass\n",
    "api/items.py": "from fastapi import APIRouter\nfrom . import users\nrouter = APIRouter(prefix='/items', dependencies=[Depends(verify)])\nrouter.include_router(users.router, prefix='/loop')\n@router.get('/{id}')\ndef one(id: int, q: Optional[Filter] = None): pass\n",
    "api/admin.py": "from api import items\nrouter = APIRouter()\nrouter.include_router(items.router, prefix='x')\n@router.delete('')\ndef drop(): pass\n",
    "api/extra.py": "router = APIRouter(prefix='extra')\n@router.put(path='//a//b')\ndef put(): pass\n",
    "lost.py": "router = APIRouter(prefix='/never')\n@router.get('/lost')\ndef lost(): pass\n",
    "deps.py": "from typing import Annotated\noauth = OAuth2PasswordBearer(tokenUrl='t')\ndef get_db(): pass\ndef get_user(token=Depends(oauth), db: Annotated[Session, Depends(get_db)] = None): pass\nCurrentUser = Annotated[User, Depends(get_user)]\n",
    "core/a.py": "def verify(x=Depends(ring)): pass\ndef ring(y=Depends(verify)): pass\ndef unused(z=Depends(ring)): pass\n",
    "core/b.py": "def verify(): pass\n",
    "models.py": "class UserIn(BaseModel):\n    f: list[Filter]\nclass UserOut(UserBaseModel): pass\nclass Filter(BaseModel): pass\nclass Other: pass\n",
    "other/models.py": "class UserOut(BaseModel): pass\n",
    "bad.py": "def (:\n",
}


def rows_of(spark, files):
    return W.extract(spark.createDataFrame(list(files.items()), "path string, content string")).cache()


def test_full_paths_along_inclusions_with_a_diamond_and_a_ring(spark):
    got = {r.function: (r.method, r.full_path, r.router) for r in W.endpoints(rows_of(spark, APP)).collect()}
    # the app's walk is main -> users -> items (-> users, seen); items' own inclusion of users is walked last, from the router api.items
    assert got == {
        "health": ("GET", "/health", "router_main_app"),
        "all_users": ("GET", "/items/loop/users", "router_api.users_router"),
        "create": ("POST", "/items/loop/users/new", "router_api.users_router"),
        "one": ("GET", "/users/{uid}/items/{id}", "router_api.items_router"),
        "drop": ("DELETE", "/admin", "router_api.admin_router"),
        "put": ("PUT", "/extra/a/b", "router_api.extra_router"),
        "lost": ("GET", "/lost", "router_lost_router"),
    }


def test_without_the_ring_the_first_inclusion_of_an_app_counts(spark):
    files = {k: v.replace("router.include_router(users.router, prefix='/loop')\n", "") if k == "api/items.py" else v.replace("router.include_router(items.router, prefix='x')\n", "") for k, v in APP.items()}
    files["api/users.py"] = APP["api/users.py"].replace("router.include_router(items.router, prefix='{uid}')\n", "")
    got = {r.function: r.full_path for r in W.endpoints(rows_of(spark, files)).collect()}
    assert got["all_users"] == "/v1/users" and got["one"] == "/items/{id}" and got["drop"] == "/admin"


def test_the_projects_own_name_in_imports(spark):
    files = {"main.py": "from shop.api import router as r\nfrom shop import more\napp = FastAPI()\napp.include_router(r, prefix='/a')\napp.include_router(more.router)\n", "api.py": "router = APIRouter(prefix='b')\n@router.get('c')\ndef f(): pass\n", "more.py": "router = APIRouter(prefix='m')\n@router.get('n')\ndef g(): pass\n"}
    assert {r.full_path for r in W.endpoints(rows_of(spark, files), root="shop").collect()} == {"/a/b/c", "/m/n"}


def test_dependencies_in_use_and_schemas(spark):
    rows = rows_of(spark, APP)
    assert {r.id for r in W.active_dependencies(rows).collect()} == {"sec_deps_oauth", "dep_deps_get_db", "dep_deps_get_user", "dep_core.a_verify", "dep_core.a_ring", "dep_core.b_verify"}
    edges, groups = W.relations(rows)
    got = {(r.from_id, r.to_id, r.relation): r for r in edges.collect()}
    for key in (
        ("ep_api.users_all_users_GET", "dep_deps_get_db", "DEPENDS_ON"),
        ("ep_api.users_create_POST", "dep_deps_get_user", "DEPENDS_ON"),
        ("dep_deps_get_user", "sec_deps_oauth", "SUB_DEPENDENCY"),
        ("dep_deps_get_user", "dep_deps_get_db", "SUB_DEPENDENCY"),
        ("dep_core.a_verify", "dep_core.a_ring", "SUB_DEPENDENCY"),
        ("ep_api.users_create_POST", "schema_models_UserIn", "REQUEST_BODY"),
        ("ep_api.items_one_GET", "schema_models_Filter", "REQUEST_BODY"),
        ("schema_models_UserIn", "schema_models_Filter", "SCHEMA_FIELD"),
    ):
        assert got[key].resolution == "unique_name" and got[key].group_id is None, key
    for key, both in ((("ep_api.users_create_POST", "schema_models_UserOut", "RESPONSE_MODEL"), {"schema_models_UserOut", "schema_other.models_UserOut"}), (("dep_core.a_ring", "dep_core.a_verify", "SUB_DEPENDENCY"), {"dep_core.a_verify", "dep_core.b_verify"})):
        assert got[key].resolution == "ambiguous" and {r.target for r in groups.where(groups.group_id == got[key].group_id).collect()} == both
    assert not any("unused" in k[0] for k in got)


def test_first_ways_equal_a_depth_first_search(spark):
    rnd = random.Random(2)
    steps = {n: [rnd.randrange(25) for _ in range(rnd.randint(0, 4))] for n in range(25)}
    want = {}
    for root in (3, 7):
        seen = {root: ()}

        def visit(n, way, seen=seen):
            for place, to in enumerate(steps[n]):
                if to not in seen:
                    seen[to] = (*way, place)
                    visit(to, seen[to])

        visit(root, ())
        want |= {(root, n): way for n, way in seen.items()}
    df = spark.createDataFrame([(n, i, to, f"{n}-{to}") for n, ts in steps.items() for i, to in enumerate(ts)], "src int, place int, dst int, label string")
    got = {(r.root, r.node): tuple(r.way) for r in first_ways(spark.createDataFrame([(3, 3), (7, 7)], "root int, node int"), df).collect()}
    assert got == want and len(want) > 20


def test_no_files(spark):
    rows = W.extract(spark.createDataFrame([], "path string, content string"))
    assert W.endpoints(rows).count() == 0 and W.relations(rows)[0].count() == 0
