"""Labelled texts in which personal information is marked: frames filled by rule.

Everything is invented. A frame is a sentence with slots; ``labelled`` fills each
frame several times with places made up by rule, adds a frame without personal
information before or after some, and puts places of every kind anywhere into
sentences that don't announce them. Marks are {e|email} {p|phone} {i|identity number}
{a|street address} {n|person's name}. The number of rows is bounded by the number
of frames times ``times``, and seventeen times ``inserted``.
"""

from __future__ import annotations

import random
import re

#: Letter of a mark: kind.
KINDS = {"e": "email", "p": "phone", "i": "identity_number", "a": "street_address", "n": "person_name"}

# Slots: n name, e email, p phone, i identity number, a address (N and A in Chinese); c component, f file, d date,
# h hash, v version, k number, r repository, g reviewers, b build or shard, C component in Chinese, w a capitalised product.
WITH = """\
Please forward the minutes to {e} and {e}.
The account owner is {n} <{e}>.
Author: {n} ({e})
Owner of the ticket: {n}, tel. {p}
Tel.: {p}, mail: {e}
Phone {p} or write to {e} if {c} stalls again.
Her number changed from {p} to {p} in {d}.
For urgent faults dial {p}, ask for {n}.
On-call this week: {n}, {p}.
Escalate to {n} at {p} when {c} drops rows.
Fax {p}
SMS to {p} was never delivered, see {f}.
WhatsApp: {p}
The caller left {p} as a callback number.
{n} rang from {p} about {c}.
Customer {n} wants {k} rows removed.
{n} said the index should stay as it is.
{n} wrote that {c} is fine again.
{n} approved {h} on {d}.
Talked to {n} about {c} and the retention of notes.
Met {n} and {n} to plan the rollout of {c}.
According to {n}, {c} needs {k} more bytes.
The request came from {n}; {c} keeps the old value.
Thanks, {n}
Best wishes\\n{n}\\n{p}
Kind regards,\\n{n}\\n{a}
Yours\\n{n}
cc: {n}, {n}
Attendees: {n}, {n}, {n}
Assigned to {n} since {d}.
Interviewed {n} (born in 1984), passport number {i}.
Remember that {n} prefers short answers.
{n}'s badge expired, the new one is sent to {a}.
Deliver the router to {a} before {d}.
Invoice address: {a}
Ship to: {n}, {a}
He moved to {a} in spring.
The office is at {a}, second entrance.
Home: {a}. Mobile: {p}.
Pick-up point {a}; ring {p}.
Visitor {n}, {a}, ID {i}
Taxpayer number {i} belongs to {n}.
SSN {i} was pasted into the prompt.
Social security number: {i}
National insurance no. {i} must be removed from {f}.
National id {i}, issued {d}
Her passport {i} was scanned by mistake.
The tax id {i} stays out of the log.
Applicant gave {i} for the check.
The user typed their identity card {i} and phone {p}.
Personal number {i} matched two records of {n}.
{n} ({i}) applied for access.
{n}, {i}, was checked at the door.
Badge of {n} ({i}) is lost.
Account of {n}: login {e}, document {i}
Write to {e} to get the key.
Reply-To: {e}
Bounced again: {e}
Invite {e} to the board of {c}.
New subscriber {e} confirmed on {d}.
User {e} cannot open {f}.
Forwarded by {e} after {k} retries.
signed-off-by: {n} <{e}>
reported by {n}, fixed in {h}
Verantwortlich ist {n}, Telefon {p}.
Ansprechpartner: {n}, {e}
{n} hat {c} am {d} abgenommen.
Laut {n} bleibt {c} so.
Mit {n} besprochen: {c} wird gelöscht.
Mobil {p}, Büro {p}
Anruf von {n} unter der Nummer {p}.
Bitte senden an {a}.
Wohnhaft: {a}
Lieferadresse {a}, Empfänger {n}
Der Umzug nach {a} ist gemeldet.
Personalausweis {i} wurde vorgelegt.
Steuernummer {i} gehört nicht ins Protokoll.
Reisepass Nr. {i}, gültig bis {d}
E-Mail von {e} ist eingegangen.
Viele Grüße\\n{n}\\n{p}
Responsable: {n}, teléfono {p}
{n} aprobó {h} el {d}.
Hablé con {n} sobre {c}.
Según {n}, {c} no cambia.
Correo: {e}, móvil: {p}
Vive en {a}.
Enviar el paquete a {a}, a nombre de {n}.
Domicilio: {a}
DNI {i} del solicitante {n}
Pasaporte {i} caducado
El número {i} aparece en {f}.
Escribir a {e} o llamar al {p}.
Saludos,\\n{n}
负责人是{N}，手机{p}。
{N}说{C}先不改。
请{N}确认{C}的容量。
和{N}讨论了{C}，{d}再看。
电话：{p}，邮箱：{e}
地址：{A}
收件人{N}，{A}
住在{A}的用户要求删除记录。
快递寄往{A}，联系{N}。
身份证号码{i}，姓名{N}
身份证：{i}
护照{i}已过期。
用户{N}的证件号是{i}，请脱敏。
邮件发给{e}即可。
请拨打{p}找{N}。
{N}、{N}和{N}参加了会议。
{N}于{d}批准了{h}。
感谢{N}，{C}已恢复。
"""

WITHOUT = """\
The index of {c} was rebuilt from {f} in {k} seconds.
Rolled {c} back to {v} because {f} failed.
{c} {v} reads {k} rows from {f}.
Clone {r} and run the check.
git remote add upstream {r}
Push to {r}, then ask {g}.
Waiting for {g} to review {h}.
cc {g} on pull request {k}
Install {c}@{v} first.
Upgrade from {c}@{v} to {c}@{v}.
Artifact {b} is in the store.
See build {b} for details.
Job {b} ran {k} times.
Row {k} of shard {b} is corrupt.
Offset {b}, partition {k}
Order number {b} was closed on {d}.
Trace id {h}-{h}, span {h}
Checksum {h} does not match {h}.
Release {w} {v} ships on {d}.
The {w} release drops {c}.
Project {w} owns {f}.
Moved {w} to the archive, {c} stays.
Open {w} Console and select {c}.
Sprint {w} ends on {d}.
Component {w} Gateway answers in {k} ms.
Between {d} and {d} the queue held {k} items.
The limit is {k} tokens, {c} used {k}.
Port {k} is taken by {c}.
Version {v} of {c} needs {k} MB.
Error {k} at line {k} of {f}.
http://{c}.example.org/{h} returned {k}
https://docs.example.com/{c}?page={k}
The call of read_notes on {f} took {k} ms.
Agreed: keep {c}, remove {c}, retry on {d}.
Decision {k}: {c} keeps snapshots for {k} days.
Next step: compare {f} with {f}.
Nobody uses {c} any more, so it can go.
Is {c} still slower than {c} since {d}?
Why does {f} mention {c} twice?
What changed in {h}, and who asked for it?
Summary: {c} was split, {c} was merged, {f} was renamed.
Lesson: check {f} before a run of {c}.
- {c}: {k}
- {w}: done on {d}
# {w} {v}
| {c} | {k} | {d} |
key={h} value={k} ttl={k}
Contact list of {c} is empty.
The phone book service {c} was switched off.
Address space of {c} grew by {k} pages.
Name of the new queue: {c}
Passport checks in {c} take {k} ms.
The street map layer of {c} is {k} MB.
Call {c} with {k} arguments.
Ask {c} for {k} rows.
Reached {k} of {k} on {d}.
Ticket {k} of {d} is closed.
Dashboard {w} shows {k} alerts for {c}.
The user prefers tables over lists.
I would rather keep the old ranking for now.
We tested it twice and it worked.
Monday is fine, Tuesday is not.
On Friday the Team Board moved to Room {k}.
Die Warteschlange von {c} wuchs um {k} Einträge.
{c} läuft wieder, {f} war schuld.
Version {v} von {c} folgt am {d}.
Der Lauf {b} brauchte {k} Sekunden.
Bitte {f} vor dem {d} prüfen.
Das Projekt {w} übernimmt {c}.
Die Adresse von {c} im Speicher ist {h}.
Der Name der Tabelle bleibt.
Nachricht {k} vom {d} fehlt.
Wir warten auf {g}.
Straßennamen werden in {c} nicht geprüft.
La cola de {c} creció en {k} filas.
{c} vuelve a funcionar, falló {f}.
La versión {v} de {c} sale el {d}.
La ejecución {b} tardó {k} segundos.
Revisar {f} antes del {d}.
El proyecto {w} usa {c}.
El nombre de la tabla no cambia.
La dirección de {c} en memoria es {h}.
Falta el mensaje {k} del {d}.
Esperamos a {g}.
Calle libre: no hay bloqueo en {c}.
{C}的队列增加了{k}条。
{C}恢复了，问题在{f}。
{c}的{v}版本于{d}发布。
任务{b}用了{k}秒。
请在{d}之前检查{f}。
项目{C}使用{c}。
表的名字不变，地址空间够用。
电话簿服务{c}已关闭。
分片{b}缺少第{k}行。
等待{g}审核{h}。
记忆里有{k}条关于{C}的记录。
为什么{C}比{c}慢？
结论：保留{C}，删除{c}，{d}重试。
构建{b}失败，见{f}。
用户更喜欢表格。
The polling loop of {c} ends after {k} rounds. (shard {b})
We never ran {f} on Windows. (row {b})
Nothing was lost. (build {b})
It was faster before. (commit {h})
As said above, the cache of {c} is warm. (row {k})
{c} and {c} use one lock, {c} has its own.
{c} and {c} exchange snapshots, {c} reads them.
{c} and {c} repeat the same filter.
Removed {k} of {k} rows from {f}.
Dropped {k} of {k} tokens and went on.
Noted that {c} stalls when {f} is open.
Saw that {c} skips empty lines.
It seems {c} never closes its files.
The link from {c} to {c} holds since {d}.
An entry of {c} points to {f}.
open_file {f}: exit {k}
run_query {c}: status {k}, {k} rows
Asked write_note to print {c}; it gave {k} lines.
Told fetch_row to drop {c}; it took {k} ms.
Loss {h}: {k} rows of {c}, {k} came back.
Fault {k}, cause {h}, found in {f}.
note {h} says the order of locks stays in {c}
THE LIST OF {c} HELD {k} OF {k} ROWS
WE KEEP {c} AND DROP {c}
Before {d} the answer took {k} ms, now it takes {k}.
Users of {c} like short lists, long ones are cut.
Can {c} run without {c}, or does it wait for {f}?
Which entries will {c} give back for {f}?
Where does {c} keep the order of its filters?
Could you undo {h}? It breaks {c}.
Yes, go on with {c}.
No, leave {f} as it is.
ok, thanks, that was all for today
Sorry, I meant {f}, not {f}.
First read {f}, then call {c}, at last write {f}.
Plan: split {c}, move {f}, test again.
## Open questions\n- who owns {c}?\n- is {f} still read?
## Results\nAll {k} checks of {c} passed.
Steps taken:\n- opened {f}\n- counted {k} rows\n- closed {c}
Given a stale index, when {c} starts, then {f} is read again.
Skill: repair {c}. Use it when {f} is missing.
Question: what limits {c}? Answer: {k} tokens.
Alert, {c} is {k} seconds behind.
{w}: version {v}, {k} downloads
Hello {w}, welcome to {c}.
North and South clusters of {w} are merged.
Chapter {k}. How {w} Stores Memories
New York, Berlin and Madrid see the same delay.
Open Source License, Apache Foundation
Google Chrome and Visual Studio Code were updated.
{C}从{k}涨到{k}，{C}没有变化。
修改{f}后，{C}由{k}减为{k}。
{c}耗时{k}毫秒，{C}为{k}。
故障{h}少了{k}条，{C}补回{k}条。
笔记{h}说明锁的顺序保留在{c}。
更新：{C}有{k}项，{c}等待检查{h}。
{f}在{k}行时正常，之后由{C}接手。
{C}能不能不用{c}？
{c}最后怎么处理别名？
用户要求图的扩展只改{f}。
{f}归{C}，不归{c}。
打开{c}报了{k}个错误。
不行，{c}还要等{C}。
已经看过{f}，一共{k}行。
{d}测得{c}需要{k}毫秒。
好的，就这样。
先读{f}，再调用{c}，最后写回。
缓存、索引和队列都已重建，{C}除外。
{C}与{c}约定：{d}之前保持不变。
问题：{C}为什么慢？回答：缺少索引。
{C}、{C}和{C}共用一个队列。
{C}组件更新到了{v}。
{C}服务重启{k}次。
{C}节点上的{f}已删除，{C}目录还在。
{C}插件缺少字段，{h}里有说明。
{C}分支合并后测试全部成功。
删掉{C}与{c}之间的关系，来源{h}。
{c}重复执行循环，{C}计数{k}次。
{k}题里{k}题答案变了，{C}再查。
{c}少了{C}的字段，改用{c}。
编号{h}：{c}在{d}之后变快。
Ticket {h} stays open.
Paper {h} lists {k} rows, not {k}
Branch {h} was merged, {c} was left for later.
With {c} stopped, {c} answers faster.
Agreed with {c} on {d}: no more retries.
The team of {c} will read {f} again.
Eintrag {h} vom {d}, Quelle {h}.
Die Verbindung endet am {d}, Grund {h}.
El registro {h} del {d}, origen {h}.
No changes.
Nothing moved today.
Nothing to add.
Kept {k} of {k} lines.
Fixed the parser of {c}, {f} follows.
Patched {f}, then merged {h}.
Added: {k} rows of {c}.
{w} now reads {f} first.
Mended in the {w} release. ({w} release)
Ships with the {w} release.
We skipped {w} and went to {w}.
(see the notes of the {w} release)
Keine Fehler.
Unverändert.
Sin errores.
Nada nuevo.
没有变化。
补充：{c}的检查通过。
在{c}里出现批量错误，{C}已核对{k}次。
现在是{k}。{C}等{d}再试。
Notes of {d} disagree with {f}.
After {d} the {c} check ran {k} times.
Nightly runs of {c} are off.
Skill {c} needs {k} rows.
Draft {h} of {c} is a week old.
Use {c} when {f} is empty.
Nach der Änderung an {f} sank {c} von {k} auf {k}.
Vorfall {h}: {k} Einträge fehlen, {c} fand {k} wieder.
Notiz {h} sagt, dass die Reihenfolge in {c} bleibt.
Ja, {c} kann weg. Nein, {f} bleibt.
Gefunden: {c} wartet auf {c}, beide stehen.
Wie viele Zeilen liefert {c} aus {f}?
Die Prüfung von {c} dauert {k} Sekunden, der Rest ist schnell.
Erst {f} lesen, dann {c} aufrufen.
Tras el cambio en {f}, {c} bajó de {k} a {k}.
Incidente {h}: faltan {k} filas, {c} recuperó {k}.
La nota {h} dice que el orden queda en {c}.
Sí, {c} sobra. No, {f} se queda.
Visto que {c} espera a {c}, ambos paran.
¿Cuántas filas devuelve {c} de {f}?
La prueba de {c} dura {k} segundos, lo demás es rápido.
Primero leer {f}, luego llamar a {c}.
"""

# Given names in use in several countries, and Chinese family names by frequency.
GIVEN = """Adam Agnes Ahmed Aisha Alba Ali Alice Amara Amir Ana Andrea Anja Anna Anton Astrid Ben Bruno Camila Carla Carlos Clara Daniel Dario David Davor Diego Dora Elena Elif Emil Emma Eric Erik Eva Farid Fatima Felix Filip Frank
Gabriel Georg Giulia Grace Greta Hana Hanna Hans Hassan Helena Henrik Henry Hugo Ida Igor Ines Ingrid Irina Isabel Ivan Ivo Jakob James Jan Javier Jens Joana John Jonas Jorge Juan Julia Karim Karin Karl Kenji Klaus Kofi
Kwame Lars Laura Layla Leila Lena Leo Lina Linh Lisa Lucas Lucia Luis Lukas Magda Maja Malik Marco Maria Marta Martin Mateo Matteo Maya Mei Mia Michael Miguel Mila Milan Mirela Mohammed Nadia Nadine Natalia Nia Nico
Nikola Nina Noor Nora Olga Oliver Omar Oskar Pablo Paul Paula Pavel Pedro Peter Petra Piet Priya Rafael Rasmus Ravi Robert Rosa Ruth Samir Sana Sanna Sara Selma Sofia Soren Stefan Sven Tanja Tariq Teodor Teresa Thea
Thomas Tim Tomas Ulla Ursula Valentina Vera Viktor Walter Wanda Xavier Yara Yuki Yusuf Zoe Zora""".split()
FAMILY_ZH = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
DOUBLE_ZH = ("欧阳", "司马", "上官", "诸葛")
TITLES = ("Dr.", "Mr.", "Mrs.", "Ms", "Ms.", "Mr", "Prof.", "Dr", "Herr", "Frau", "Sr.", "Sra.", "Doña")
THINGS = "Amber Anchor Atlas Autumn Beacon Birch Blue Bridge Canyon Cedar Circle Cloud Coral Delta Eagle Ember Falcon Forest Garden Glacier Golden Granite Green Harbor Iron Island Lantern Maple Marble Meadow Mirror Moon North Ocean Orchid Osprey Pearl Pine Prairie Quiet Rapid Raven Red River Rocket Sage Silver Spring Stone Storm Summer Sunset Swift Tiger Velvet Violet Willow Winter".split()
ONSETS, VOWELS, CODAS = "b br c d dr f fl g gr h j k kl l m n p pr qu r s sch st t tr v w y z".split(), "a e i o u ai ei ou ie".split(), "l m n r s t x nd rt lk ck ng th".split()


class Filler:
    """Invented values of every slot."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def stem(self, least: int = 2) -> str:
        r = self.rng
        return "".join(r.choice(ONSETS) + r.choice(VOWELS) + (r.choice(CODAS) if r.random() < 0.5 else "") for _ in range(r.randint(least, 3)))

    def han(self, n: int) -> str:
        """Common and rare characters."""
        r = self.rng
        low, high = (0xB0, 0xD7) if r.random() < 0.35 else (0xD8, 0xF7)
        return "".join(bytes((r.randint(low, high), r.randint(0xA1, 0xF9))).decode("gb2312", "replace")[0].replace("�", "珂") for _ in range(n))

    def surname(self) -> str:
        s = self.stem().capitalize()
        return s + "-" + self.stem().capitalize() if self.rng.random() < 0.12 else s

    def given(self) -> str:
        return self.stem().capitalize() if self.rng.random() < 0.35 else self.rng.choice(GIVEN)

    def n(self) -> str:
        k, r = self.rng.random(), self.rng
        if k < 0.4:
            return f"{self.given()} {self.surname()}"
        if k < 0.5:
            return f"{self.given()} {r.choice('ABCDEFGHJKLMNPRSTVW')}. {self.surname()}"
        if k < 0.65:
            return f"{r.choice('ABCDEFGHIJKLMNOPRSTUVWYZ')}. {self.surname()}"
        if k < 0.85:
            return f"{r.choice(TITLES)} {self.surname()}"
        if k < 0.9:
            return f"{r.choice(TITLES)} {self.given()} {self.surname()}"
        return f"{self.surname()}, {self.given()}"

    def N(self) -> str:
        r = self.rng
        return (r.choice(DOUBLE_ZH) if r.random() < 0.06 else r.choice(FAMILY_ZH)) + self.han(r.choice((1, 2, 2)))

    def e(self) -> str:
        r = self.rng
        user = r.choice((self.stem(), self.stem() + self.digits(2), f"{self.stem()}.{self.stem()}", f"{self.stem()}_{self.stem()}", f"{r.choice('abcdefgh')}.{self.stem()}", f"{self.stem()}+{self.stem(1)}"))
        host, end = r.choice((self.stem(), f"mail.{self.stem()}", f"{self.stem()}-{self.stem(1)}")), r.choice(("com", "org", "net", "de", "es", "cn", "example", "test", "invalid", "example.com", "example.org", "example.net", "co.uk"))
        k = r.random()
        if k < 0.08:
            return f"{user} {r.choice(('(at)', '[at]'))} {host} {r.choice(('(dot)', '[dot]'))} {end.replace('.', ' (dot) ')}"
        if k < 0.14:
            return f"{user} {r.choice(('(at)', '[at]'))} {host}.{end}"
        if k < 0.2:
            return f"{user}＠{host}.{end}"
        if k < 0.26:
            return f"<mailto:{user}@{host}.{end}>"
        return f"{user}@{host}.{end}".upper() if k < 0.36 else f"{user}@{host}.{end}"

    def p(self) -> str:
        d, r = self.digits, self.rng
        area = r.choice("23456789") + d(2)
        return r.choice(
            (
                f"+1 {area} 555 {d(4)}", f"({area}) 555-{d(4)}", f"{area}-555-{d(4)}", f"{area}.555.{d(4)}", f"{area}-555-{d(4)} ext. {d(r.choice((2, 3)))}", f"{area}-555-{d(4)} x{d(3)}", f"001{area}555{d(4)}", f"+1{area}555{d(4)}",
                f"+44 20 {d(4)} {d(4)}", f"07{d(3)} {d(6)}", f"07{d(3)} {d(3)} {d(3)}", f"+44 7{d(3)} {d(6)}", f"020 {d(4)} {d(4)}",
                f"+49 {d(2)} {d(5)} {d(3)}", f"+49 1{d(2)} {d(8)}", f"0{d(3)}/{d(7)}", f"030 {d(8)}", f"+33 6 {d(2)} {d(2)} {d(2)} {d(2)}", f"06 {d(2)} {d(2)} {d(2)} {d(2)}",
                f"+34 6{d(2)} {d(3)} {d(3)}", f"91 {d(3)} {d(2)} {d(2)}", f"6{d(2)} {d(3)} {d(3)}", f"04{d(2)} {d(3)} {d(3)}", f"+61 4{d(2)} {d(3)} {d(3)}", f"1{r.choice('3589')}{d(9)}", f"+86 1{r.choice('3589')}{d(1)} {d(4)} {d(4)}", f"010-{d(8)}", f"555-{d(4)}-{d(4)}",
            )
        )

    def i(self) -> str:
        d, r = self.digits, self.rng
        letter = lambda: r.choice("ABCDEFGHJKLMNPRSTVWXYZ")
        born = f"{r.randint(1940, 2010)}{r.randint(1, 12):02}{r.randint(1, 28):02}"
        return r.choice(
            (
                f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{letter()}{letter()} {d(2)} {d(2)} {d(2)} {letter()}", f"{letter()}{letter()}{d(6)}{letter()}", f"{d(8)}-{letter()}", f"{d(8)}{letter()}", f"{r.choice('XYZ')}{d(7)}{letter()}",
                f"{d(3)} {d(3)} {d(3)}", f"{letter()}{letter()}{d(7)}", f"{letter()}{d(8)}", f"{letter()}{d(2)}{letter()}{d(2)}{letter()}{d(2)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(6)}{born}{d(4)}", f"{d(6)}{born}{d(3)}X", f"{d(6)}{born}{d(4)}",
            )
        )

    def a(self) -> str:
        r = self.rng
        s, town, no = self.stem().capitalize(), self.stem().capitalize(), r.choice((f"{r.randint(1, 240)}", f"{r.randint(1, 240)}", f"{r.randint(1, 240)}{r.choice('ABCDabc')}"))
        street = f"{s} {r.choice(('Street', 'Road', 'Lane', 'Avenue', 'Ave', 'St', 'Drive', 'Close', 'Way', 'Court', 'Square', 'Rd.', 'Boulevard'))}"
        german = s.lower().capitalize() + r.choice(("straße", "strasse", "weg", "platz", "gasse", "allee", "ring", "ufer", "damm"))
        spanish = f"{r.choice(('Calle', 'Avenida', 'Plaza', 'Paseo', 'C/', 'Camino', 'Ronda'))} {r.choice(('', '', 'de ', 'del '))}{s}"
        return r.choice(
            (
                f"{no} {street}, {town}", f"{no} {street}", f"{street} {no}, {town}", f"Flat {r.randint(1, 60)}, {no} {street}, {town}", f"{no} {street}\\n{town} {self.digits(5)}", f"{no} {street}, Suite {r.randint(1, 400)}, {town} {self.digits(5)}",
                f"{german} {no}, {self.digits(5)} {town}", f"{german} {no}", f"{german} {no}, {town}", f"{german} {no}, {self.digits(5)} {town}",
                f"{spanish} {no}, {r.randint(1, 9)}º {r.choice('ABCD')}, {town}", f"{spanish} {no}, {town}", f"{spanish}, {no}, {self.digits(5)} {town}", f"{spanish} {no}",
            )
        )

    def A(self) -> str:
        r = self.rng
        out = r.choice((f"{self.han(r.choice((2, 2, 3)))}市", "", f"{self.han(2)}省{self.han(2)}市")) + r.choice((f"{self.han(2)}区", "", f"{self.han(2)}县"))
        out += self.han(r.choice((2, 3, 3))) + r.choice("路街道巷") + f"{r.randint(1, 900)}号"
        return out + r.choice(("", "", f"{r.randint(1, 30)}栋{r.randint(101, 2900)}室", f"{r.randint(1, 9)}单元{r.randint(101, 909)}"))

    def c(self) -> str:
        a, b = self.stem(), self.stem(1)
        return self.rng.choice((a, f"{a}-{b}", f"{a}-{self.rng.choice(('sync', 'index', 'cache', 'queue', 'hub', 'gate', 'relay', 'agent', 'worker', 'store', 'proxy'))}", f"{a}_{b}", f"{a.capitalize()}-{b}", a.capitalize(), f"{a}-{b}-{self.stem(1)}"))

    def C(self) -> str:
        return self.han(self.rng.choice((2, 2, 3)))

    def w(self) -> str:
        """Names of products and releases: ordinary words, or one invented word."""
        r = self.rng
        return r.choice((self.stem().capitalize(), r.choice(THINGS), f"{r.choice(THINGS)} {r.choice(THINGS)}", f"{self.stem().capitalize()} {r.choice(THINGS)}"))

    def f(self) -> str:
        return f"{self.rng.choice(('src', 'lib', 'core', 'docs', 'jobs', 'tools'))}/{self.stem()}{self.rng.choice(('/' + self.stem(1), '_' + self.stem(1), ''))}.{self.rng.choice(('py', 'js', 'md', 'sql', 'toml', 'yaml', 'go'))}"

    def d(self) -> str:
        return f"{self.rng.randint(2019, 2027)}-{self.rng.randint(1, 12):02}-{self.rng.randint(1, 28):02}"

    def h(self) -> str:
        return "".join(self.rng.choice("0123456789abcdef") for _ in range(self.rng.choice((6, 7, 8, 12))))

    def v(self) -> str:
        return f"{self.rng.randint(0, 20)}.{self.rng.randint(0, 40)}.{self.rng.randint(0, 20)}" + self.rng.choice(("", "", "", f"-{self.digits(3)}"))

    def k(self) -> str:
        return self.digits(self.rng.randint(1, 6)).lstrip("0") or "7"

    def r(self) -> str:
        return f"{self.rng.choice(('git', 'git', 'deploy', self.stem()))}@{self.stem()}.{self.rng.choice(('example', 'org', 'com'))}:{self.stem()}/{self.stem()}{self.rng.choice(('.git', ''))}"

    def g(self) -> str:
        return f"@{self.stem()}-{self.rng.choice(('reviewers', 'team', 'owners', 'maintainers'))}"

    def b(self) -> str:
        d = self.digits
        return self.rng.choice((f"{self.rng.randint(2020, 2027)}-{d(2)}-{d(4)}-{d(4)}", f"{d(4)}-{d(4)}-{d(2)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(2)}-{d(2)}-{d(4)}", f"{d(10)}", f"{d(8)}-{d(5)}", f"#{d(7)}", f"555-{d(4)}", f"{d(3)}-{d(4)}"))


def labelled(times: int = 4, seed: int = 11, frames: tuple[list[str], list[str]] | None = None, inserted: int = 100) -> list[str]:
    """Each frame filled ``times`` times (those without personal information half as often), almost half of them next to another sentence.

    Sentences more, ``inserted`` times a weight of each kind, have a place of it at any gap between words.
    """
    having, lacking = frames or (WITH.splitlines(), WITHOUT.splitlines())
    fill = Filler(seed)
    rng = fill.rng

    def filled(frame: str) -> str:
        def value(m: re.Match) -> str:
            v = getattr(fill, m[1])()
            return f"{{{m[1].lower()}|{v}}}" if m[1] in "neipaNA" else v

        return re.sub(r"\{(\w)\}", value, frame)

    rows = []
    for group, n in ((having, times), (lacking, max(1, times // 2))):
        for frame in group:
            for _ in range(n):
                row = filled(frame)
                k = rng.random()
                between = rng.choice((" ", " ", "\\n", "\\n\\n", "\\n- ", "\\n## "))
                if k < 0.25:
                    row = f"{row}{between}{filled(rng.choice(lacking))}"
                elif k < 0.45:
                    row = f"{filled(rng.choice(lacking))}{between}{row}"
                rows.append(row)
    for kind in "nnneeiiippppaaNNA":
        for _ in range(inserted):
            frame = rng.choice(lacking)
            if kind in "NA" or (kind in "epi" and rng.random() < 0.15):
                while not re.search("[\u4e00-\u9fff]", frame):
                    frame = rng.choice(lacking)
                gaps = [m.start() for m in re.finditer("[，。：]", frame)] + [0]
                at, blank = rng.choice(gaps), ""
            else:
                gaps = [m.start() for m in re.finditer(r"\s|$", frame)] + [0]
                at, blank = rng.choice(gaps), " "
            end = rng.choice((blank, blank, blank or "，", "; ", ", ", ". ")) if at == 0 else ""
            rows.append(filled(frame[:at] + (rng.choice((blank, blank, blank, ": ", ", ", " (")) if at else "") + f"{{{kind}}}" + end + frame[at:]))
    return rows
